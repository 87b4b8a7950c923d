"""Posting, mail, verdict and source operators on written cases, and the status fold against a fold in order."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tarnwick.functions import mail, names
from tarnwick.operators import entity, verdicts
from tarnwick.sources import landed


def _values(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", column(F.col("t"))).orderBy("i").collect()]


def test_company_and_title_keys(spark):
    assert _values(spark, names.company_key, ["Acme GmbH", "Acme Holding AG", "ACME (Europe) Ltd.", "Ærø Skibe A/S", "Labs", "Nestlé S.A.", None, ""]) == ["acme", "acme", "acme", "aeroskibe", "", "nestlesa", "", ""]
    titles = ["Data Engineer - Paris", "Data Engineer (m/f/d)", "Dev - Remote", "Engineer, Backend", "Data Engineer - all about the things we do all day", "C++ Entwickler", None]
    assert _values(spark, names.title_key, titles) == ["dataengineer", "dataengineer", "devremote", "engineer", "dataengineerallaboutthethingswedoallday", "c++entwickler", ""]


def test_fingerprint_and_dedup_keys(spark):
    df = spark.createDataFrame([("Acme Inc", "Senior Dev (remote)", None, None, "Paris, FR"), ("", "x", "http://www.a.b/c?d", "http://a.b/e/", None), (None, None, None, None, None)], "c string, t string, u string, d string, p string")
    rows = df.select(names.posting_fingerprint(F.col("c"), F.col("t")), names.dedup_keys(F.col("u"), F.col("d"), F.col("c"), F.col("t"), F.col("p"), ("confidential",))).collect()
    assert [r[0] for r in rows] == ["acme|dev", None, None]
    assert [r[1] for r in rows] == [["tc:seniordev|acme|paris"], ["u:a.b/c", "u:a.b/e"], []]


def test_mail(spark):
    assert _values(spark, mail.subject_core, ["RE: Fwd: [EXT] Application for Data  Engineer", "Follow-up #2: Hello", None]) == ["data engineer", "hello", ""]
    assert _values(spark, mail.own_text, ["Thanks!\n> old\nBye\nOn Monday, A B <a@b.c> wrote:\nold", "plain", "", None]) == ["Thanks!\nBye", "plain", "", ""]
    assert _values(spark, mail.unconditional, ["We met. We will call if you are selected. Bye.", None]) == ["We met. Bye.", ""]
    assert _values(spark, mail.meeting_link, ["see https://x.zoom.us/j/123. ok", "none", None]) == ["https://x.zoom.us/j/123", None, None]


def test_long_and_hostile_texts(spark):
    from tarnwick.functions import urls

    texts = ["a@b" + ".c" * 100_000, " " * 300_000 + "x", "re: " * 20_000 + "x", "inc " * 2_000 + "ltd", "w" * 1_000_000, "w" * 300_000 + "@firm.com"]
    assert _values(spark, urls.emails, texts) == [[], [], [], [], [], ["w" * 300_000 + "@firm.com"]]
    assert _values(spark, mail.subject_core, texts)[2] == "x"
    assert _values(spark, names.company_key, texts)[3] == ""


def test_addresses(spark):
    from tarnwick.functions import urls

    texts = ["Write to Jane.Doe [at] firm [dot] com or jobs@firm.co.uk.please", "noreply@firm.com a@firm.com x@y.png bb@example.com", "Bob @ firm . io, BOB@FIRM.IO", None]
    assert _values(spark, urls.emails, texts) == [["jane.doe@firm.com", "jobs@firm.co.uk"], [], ["bob@firm.io"], []]


def test_character_references(spark):
    from tarnwick.functions import text

    assert _values(spark, text.plain_html, ["<p>Fish &amp; chips &#8211; 5&#x20AC; &nosuch; &lt;b&gt;</p><script>x</script>", "&amp;amp; &#55555; &#0;", None]) == ["Fish & chips – 5€ &nosuch;", "& &#55555; &#0;", None]


def test_pay_ranges(spark):
    from tarnwick.functions.dates import salary

    cases = ["$20 - $30", "$80k–120k", "$300 - $400", "$29,000 - $31,000", "$1,500.75—$2,000", "$90,000 - $120k", "$100 - $50", "pay", None]
    want = [("hourly", 20.0, 30.0), ("yearly", 80000.0, 120000.0), None, None, ("monthly", 1500.0, 2000.0), None, None, None, None]
    assert [r and tuple(r)[:3] for r in _values(spark, salary, cases)] == want


def test_nordic_and_french_mail(spark):
    assert _values(spark, mail.subject_core, ["SV: Réf: Antw: Automatic reply : Offer", "[list] VS: x"]) == ["offer", "x"]
    assert _values(spark, mail.own_text, ["Tack!\nDen 3 maj 2024 skrev A B <a@b.c>:\nold", "Merci\n-- Message d'origine --\nold", "Hej\nFrån: A\nold"]) == ["Tack!", "Merci", "Hej"]
    assert _values(spark, mail.meeting_link, ["join meet.google.com/abc-defg-hij."]) == ["https://meet.google.com/abc-defg-hij"]


def test_merge_of_a_cluster(spark):
    rows = [(1, 7, "short", "Entreprise (x)", ["A@b.co"], None, None, "Paris", 30.0, "1d ago", False, "one"), (2, 7, "a longer text", "Acme", ["a@b.co", "c@d.co"], "$5", None, "Lyon", 4.0, "4h ago", True, "two"), (3, 8, None, None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "seq long, cluster long, description string, company string, emails array<string>, salary string, direct string, place string, age_hours double, age_label string, easy boolean, site string")
    got = {r.cluster: tuple(r)[1:] for r in entity.merge_cluster(df, "cluster", "seq").collect()}
    assert got[7] == (1, 2, "a longer text", "Acme", "a@b.co,c@d.co", "$5", None, "Paris", 4.0, "4h ago", True, "one,two")
    assert got[8] == (3, 1, "", "", "", None, None, None, None, None, False, "")


def test_verdict_parts(spark):
    assert _values(spark, verdicts.amounts, ["$80k to EUR 90.000, 70,000", None]) == [[80000, 90000], []]
    assert _values(spark, lambda c: verdicts.pay_score(c, F.lit("")), ["120,000", "6000", "900", None]) == [4.5, 4.0, 3.0, 3.0]
    kinds = dict.fromkeys(("bot", "expired", "apply", "soft", "listing"), "zzz") | {"expired": "no longer accepting", "apply": "apply now"}
    live = lambda c: verdicts.liveness(F.lit(200), F.lit("77"), F.lit("http://a/77"), c, c, kinds, 5)
    assert _values(spark, live, ["No longer accepting", "Apply now", "abc", "plenty of text", None]) == ["expired_body", "apply_control_visible", "js_rendered", "no_apply_control", "js_rendered"]


def _fold(cur, timeout, intents):
    for x in intents:
        shut = cur == "rejected" and not timeout
        if cur == "accepted":
            break
        if x == "offer":
            cur = "offer"
        elif cur == "offer":
            continue
        elif x == "rejected":
            timeout = timeout and cur == "rejected"
            cur = "rejected"
        elif x == "interview" and not shut:
            cur = "interview"
        elif x == "review" and not shut and cur in ("applied", "sent", "saved", "rejected"):
            cur = "review"
        if cur != "rejected":
            timeout = False
    return cur


def test_final_status_equals_fold(spark):
    rng, rows, want = random.Random(5), [], {}
    for k in range(600):
        cur, timeout = rng.choice(["applied", "saved", "interview", "review", "rejected", "offer", "accepted"]), rng.random() < 0.5
        timeout = timeout and cur == "rejected"
        intents = [rng.choice(["offer", "rejected", "interview", "review", "other", None]) if rng.random() < 0.5 else rng.choice(["rejected", "review", "interview"]) for _ in range(rng.randint(1, 6))]
        rows += [(k, i, x, cur, timeout) for i, x in enumerate(intents)]
        want[k] = _fold(cur, timeout, intents)
    df = spark.createDataFrame(rows, "k long, i long, intent string, cur string, timeout boolean")
    got = {r.k: r.status for r in entity.final_status(df, "k", F.col("i"), "intent", "cur", "timeout").collect()}
    bad = [(k, got[k], want[k], [r for r in rows if r[0] == k]) for k in want if got[k] != want[k]]
    assert not bad, bad[:3]


def test_first_posts_reserve_nothing(spark):
    long = "x" * 60
    df = spark.createDataFrame([(1, "u", long), (2, "u", "y" * 60), (3, "v", "y" * 60), (4, None, long), (5, None, "short"), (6, None, "short")], "i long, u string, t string")
    assert sorted(r.seq for r in entity.first_posts(df, "i", "u", F.col("t")).collect()) == [1, 3, 5, 6]


def test_landed_sources(spark, tmp_path):
    spark.createDataFrame([(1, "=a\nb")], "n long, t string").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([], "t string").write.parquet(str(tmp_path / "b"))
    schema = StructType([StructField("n", LongType()), StructField("t", StringType())])
    sources = {x: ("parquet", str(tmp_path / x)) for x in "abc"}
    rows, failures = landed.union_sources(spark, sources, schema)
    assert {(r.site, r.status, r.n) for r in landed.source_status(rows, list(sources), failures).collect()} == {("a", "success", 1), ("b", "warning", 0), ("c", "error", 0)}
    landed.write_csv(rows, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().t == "'=a · b"


@pytest.mark.parametrize("given", [{"gone": ("parquet", "/nowhere/x")}, {}])
def test_no_source_gives_no_rows(spark, given):
    rows, failures = landed.union_sources(spark, given, StructType([StructField("n", LongType())]))
    assert rows.columns == ["site", "n"] and rows.count() == 0 and set(failures) == set(given)
