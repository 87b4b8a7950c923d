"""Public and reserved URLs, against Python's own address rules."""

import ipaddress
import random

from pyspark.sql import functions as F

from tarnwick.functions import hosts


def blocked(address):
    a = ipaddress.ip_address(address)
    return a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast or a.is_unspecified or (a.version == 6 and a.is_site_local)


CASES = {
    "http://127.0.0.1:8000/admin": False, "http://169.254.169.254/latest/meta-data/": False, "http://localhost:5432/": False, "http://LOCALHOST./": False, "https://db.internal/x": False, "http://a.local": False, "https://x.localhost/": False,
    "http://0.0.0.0/": False, "http://2130706433/": False, "http://0x7f000001/": False, "http://0177.0.0.1/": False, "http://127.1/": False, "http://[::1]/": False, "http://[fe80::1%25eth0]/": False, "http://[::ffff:10.0.0.1]/": False, "http://[fc00::1]": False,
    "http://user:pw@10.0.0.1/": False, "http://8.8.8.8@192.168.0.1/": False, "http://192.168.0.1@8.8.8.8/": True, "https://8.8.8.8/dns": True, "http://[2606:4700::1111]:443/": True, "https://acme.com/jobs?id=1": True, "HTTPS://Acme.com:8443": True,
    "ftp://acme.com": False, "acme.com": False, "": False, None: False, "http://": False, "http://acme.com:99999/": False, "http://acme.com:port/": False, "http://999.1.1.1/": False, "http://1.2.3.4.5/": False, "http://300.300/": False, "http://[1::2::3]/": False,
    "http://134744072/": True, "http://08.8.8.8/": False, "  https://acme.com  ": True, "http://[2001:db8::5]/": False, "http://x" + "a." * 200_000 + "com/": True,
}


def test_cases(spark):
    rows = list(CASES.items())
    got = spark.createDataFrame(rows, "url string, want boolean").select("url", "want", hosts.public_url(F.col("url")).alias("got")).collect()
    assert [(r.url, r.got) for r in got if r.got != r.want] == []


def test_random_addresses(spark):
    rng = random.Random(1)
    four = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(1500)] + [f"{a}.{rng.randrange(256)}.{rng.randrange(256)}.1" for a in (10, 127, 169, 172, 192, 198, 203, 224, 240) for _ in range(40)]
    six = [str(ipaddress.IPv6Address(rng.getrandbits(128) >> rng.choice([0, 0, 64, 96]))) for _ in range(600)] + [str(ipaddress.IPv6Address((0x2A00 << 112) | rng.getrandbits(rng.choice([112, 40, 8])))) for _ in range(300)]
    rows = [(a, f"http://{a}/") for a in four] + [(a, f"http://[{a}]/") for a in six]
    got = spark.createDataFrame(rows, "a string, url string").select("a", hosts.public_url(F.col("url")).alias("ok"), hosts.address_key(F.col("a")).alias("key")).collect()
    for r in got:
        a = ipaddress.ip_address(r.a)
        assert r.key == f"{a.version}{int(a):0{8 if a.version == 4 else 32}x}"
        mapped = a.version == 6 and a.ipv4_mapped
        assert r.ok == (not blocked(r.a) and not mapped), r.a


def test_resolved_names(spark):
    rows = [("http://a.com", ["8.8.8.8"]), ("http://a.com", ["8.8.8.8", "10.0.0.1"]), ("http://a.com", []), ("http://a.com", None), ("http://8.8.8.8", None), ("http://a.com", ["bad"]), ("http://a.com", [None]), ("http://a.com", ["2606:4700::1"])]
    df = spark.createDataFrame(rows, "url string, seen array<string>").coalesce(1)
    assert [r[0] for r in df.select(hosts.public_url(F.col("url"), F.col("seen"))).collect()] == [True, False, False, False, True, False, False, True]
