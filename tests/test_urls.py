"""Canonical URLs of every known board family, of a board that the caller names, and of others."""

from pyspark.sql import functions as F

from tarnwick.functions.urls import BOARDS, canonical_url

ID = "0123456789abcdef0123456789abcdef"
CASES = {
    "https://www.linkedin.com/jobs/search/?currentJobId=4012345678&x=1": "linkedin:4012345678",
    "https://de.linkedin.com/jobs/view/data-engineer-at-acme-4012345678?trk=a": "linkedin:4012345678",
    "https://uk.indeed.com/viewjob?x=1&jk=AB12cd": "indeed:ab12cd",
    "https://apply.example.com/?jk=ab12cd": "indeed:ab12cd",
    "https://acme.com/careers?gh_jid=778899": "greenhouse:778899",
    "https://boards.greenhouse.io/acme/jobs/778899": "greenhouse:778899",
    f"https://jobs.lever.co/acme/{ID}/apply": f"lever:acme/{ID}",
    f"https://jobs.ashbyhq.com/acme/{ID}": f"ashby:acme/{ID}",
    "https://www.tanitjobs.com/job/12345/dev": "tanitjobs:12345",
    "https://www.keejob.com/offres-emploi/12345/dev": "keejob:12345",
    "https://www.ejobs.ro/user/locuri-de-munca/dev/12345": "ejobs:12345",
    "https://www.hipo.ro/locuri-de-munca/locuri_de_munca/12345/a": "hipo:12345",
    "https://www.hellowork.com/fr-fr/emplois/12345.html": "hellowork:12345",
    "https://www.reed.co.uk/jobs/dev/12345?s=1": "reed:12345",
    "https://www.karriere.at/jobs/12345": "karriere_at:12345",
    "https://www.itjobs.pt/oferta/12345/dev": "itjobs_pt:12345",
    "https://www.rekrute.com/offre-emploi-dev-acme-12345.html": "rekrute:12345",
    "https://www.seek.com.au/job/12345": "seek:12345",
    "https://www.jobstreet.com.my/id/job/12345": "seek:12345",
    f"https://www.mycareersfuture.gov.sg/job/dev-acme-{ID}": f"mycareersfuture:{ID}",
    "https://www.wanted.co.kr/wd/12345": "wanted_kr:12345",
    "https://djinni.co/jobs/12345-dev/": "djinni:12345",
    "https://www.finn.no/job/ad.html?finnkode=12345": "finn:12345",
    "https://www.talent.com/view?id=ab12": "talent:ab12",
    "https://www.talent.com/view?id=ab13": "talent:ab13",
    "HTTP://www.a.b/c/d;jsessionid=9F?x#y": "a.b/c/d",
    "https://a.b/c/": "a.b/c",
}
#: A path between the board's fixed part and its id that the reference's pattern does not allow: the plain URL.
CASES |= {
    f"https://www.mycareersfuture.gov.sg/job/it/dev-acme-{ID}": f"mycareersfuture.gov.sg/job/it/dev-acme-{ID}",
    "https://www.finn.no/job/fulltime/ad.html?finnkode=12345": "finn.no/job/fulltime/ad.html",
}


def test_every_board_family(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "u string")
    assert {r.u: r.c for r in df.select("u", canonical_url(F.col("u")).alias("c")).collect()} == CASES
    assert df.limit(1).select(canonical_url(F.lit(None).cast("string")).alias("c")).first().c is None


def test_boards_are_a_parameter(spark):
    own = (("town", r"town\.example/post/([0-9]+)", (1,)), *BOARDS)
    urls = ["https://town.example/post/12?x=1", "https://www.karriere.at/jobs/12345"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert sorted(r[0] for r in df.select(canonical_url(F.col("u"), own)).collect()) == ["karriere_at:12345", "town:12"]
