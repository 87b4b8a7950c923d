"""Secret scanning: base patterns, and weak candidates linked by what stands near them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwick.llm.common import cut
from tarnwick.llm.simhash_index import text_key

#: Fixed patterns of the base kinds. Runs that are too short are dropped; where a shorter match could not
#: hide a longer one, the least length stands in the pattern.
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
#: Fixed patterns of weak candidates: account names and other key ids, long mixed tokens, addresses of services.
IDENT = r"""(?:A(?:SIA|ROA|IDA|GPA)[A-Z0-9]{12,}|(?i:(?:client_id|user(?:name)?|login|account))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,})"""
LONG = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9A-Z+/_=-]*[a-z])(?=[0-9a-z+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,}"
#: Groups that repeat are possessive (++): Java's engine recurses once for each turn of any other, and long texts would exhaust its stack.
ENDPOINT = r"""(?:https?://[^\s"'<>]+|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)++|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.]))"""

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "ident", "long", "endpoint")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, IDENT, LONG, ENDPOINT), strict=True))
BASE = KINDS[:3]
#: What a kind can be part of a credential as, and which other parts a weak candidate needs near it.
ROLE = {"assign": "secret", "access": "ident", "hex": "secret", "ident": "ident", "long": "secret", "endpoint": "endpoint"}
NEEDS = {"ident": ["secret"], "long": ["ident"], "endpoint": ["ident", "secret"]}
#: Code points between two parts of one credential, at most.
SCOPE = 200
#: Code points of a piece in which redact() cuts spans out.
CHUNK = 4_096


def _found(text: Column, no: int, kind: str) -> Column:
    """Lengths of the pieces between matches and of the matches: positions follow from their running sums."""
    pattern = F.lit(PATTERNS[kind])
    size = lambda x: F.char_length(x)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    least = F.regexp_extract_all(text, pattern, F.lit(1)) if kind == "assign" else whole
    zipped = F.arrays_zip(
        F.transform(F.split(text, PATTERNS[kind], -1), size).alias("gap"), F.transform(whole, size).alias("len"), F.transform(least, size).alias("counted")
    )
    return F.when(text.rlike(PATTERNS[kind]), F.struct(F.lit(no).alias("kind"), zipped.alias("runs")))


def found_runs(text: Column) -> Column:
    """What the patterns find in a text, by kind; empty if nothing. The only step that reads texts."""
    return F.filter(F.array(*[_found(text, no, kind) for no, kind in enumerate(KINDS)]), lambda x: x.isNotNull())


def spans(texts: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(k0, k1, kind, start, stop) for each distinct text, which k0 and k1 stand for; see linked()."""
    text = F.col("text")
    rows = texts.select(F.col(text_col).alias("text")).where("text is not null")
    return linked(rows.select(*[k.alias(f"k{i}") for i, k in enumerate(text_key(text))], found_runs(text).alias("found")), scope)


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(k0, k1, kind, start, stop) of the spans that count, from (k0, k1, found) with found_runs() of each text.

    `kind` indexes KINDS. Base kinds always count. A weak candidate counts only if it overlaps no base
    span and each part that it needs (an access identifier, a secret) lies within `scope` code points
    of it. The interval join meets in bins of `scope` code points, where each role is
    reduced to its first start and last stop, so a text full of candidates makes no pairs.
    """
    runs = found.select("k0", "k1", F.explode("found").alias("f")).select("k0", "k1", "f.kind", F.posexplode("f.runs").alias("pos", "run"))
    runs = runs.where("run.len is not null").select("k0", "k1", "kind", "pos", "run.gap", "run.len", "run.counted").distinct()
    upto = Window.partitionBy("k0", "k1", "kind").orderBy("pos")
    stop = (F.sum("gap").over(upto) + F.sum("len").over(upto)).cast("long")
    placed = runs.select("k0", "k1", "kind", (stop - F.col("len")).alias("start"), stop.alias("stop"), "counted")
    placed = cut(placed.where((F.col("kind") != 0) | (F.col("counted") >= ASSIGN_LEAST)).drop("counted"))  # texts are searched once
    role = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("kind") + 1)
    bins = lambda more: F.explode(F.sequence(F.floor(F.col("start") / scope) - more, F.floor((F.col("stop") - 1) / scope) + more))
    base = placed.where(F.col("kind") < len(BASE))
    solid = base.select("k0", "k1", bins(0).alias("bin"), F.col("start").alias("s"), F.col("stop").alias("e"))
    weak = placed.where(F.col("kind") >= len(BASE)).withColumn("bin", bins(0))
    same = [F.col(f"w.{x}") == F.col(f"b.{x}") for x in ("k0", "k1", "bin")]
    overlap = [F.col("w.start") < F.col("b.e"), F.col("b.s") < F.col("w.stop")]
    struck = weak.alias("w").join(solid.alias("b"), [*same, *overlap], "left_semi").select("k0", "k1", "kind", "start").distinct()
    weak = weak.drop("bin").distinct().join(struck, ["k0", "k1", "kind", "start"], "left_anti")
    parts = base.union(weak).select("k0", "k1", role.alias("role"), bins(0).alias("bin"), "start", "stop")
    reach = parts.groupBy("k0", "k1", "bin", "role").agg(F.min("start").alias("s"), F.max("stop").alias("e"))
    near = (
        weak.withColumn("bin", bins(1)).join(reach, ["k0", "k1", "bin"])
        .where((F.col("s") <= F.col("stop") + scope) & (F.col("e") >= F.col("start") - scope))
        .groupBy("k0", "k1", "kind", "start", "stop").agg(F.collect_set("role").alias("roles"))
    )
    needs = F.lit(False)
    for kind, roles in NEEDS.items():
        needs = needs | ((F.col("kind") == KINDS.index(kind)) & (F.size(F.array_intersect("roles", F.array(*map(F.lit, roles)))) == len(roles)))
    return base.union(near.where(needs).drop("roles"))


def _listed(rows: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(rows), lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"], x["stop"])), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each row of df: its id, counts of base kinds, a digest of base spans, all spans.

    Null and empty texts have no spans: counts 0, the digest of an empty string, an empty list. Equal texts
    are scanned in each row but placed once, by a 128-bit key; repeated rows come back as often as they
    came; an empty table gives an empty result; other columns are not looked at, whatever their names. Offsets count
    code points. Very long texts are searched whole, in time that grows with their length; spans that start
    together are listed in the order of KINDS (ties).
    """
    found = spans(df, text_col, scope)
    one = F.struct("start", "kind", "stop")
    by_text = cut(found.groupBy("k0", "k1").agg(  # a table, so that the join below may split a text with many copies
        *[F.count_if(F.col("kind") == no).alias(f"n_{kind}") for no, kind in enumerate(BASE)],
        F.collect_list(F.when(F.col("kind") < len(BASE), one)).alias("base"), F.collect_list(one).alias("all"),
    ))
    rows = df.select(F.col(id_col).alias("id"), *[k.alias(f"k{i}") for i, k in enumerate(text_key(F.col(text_col)))])
    return rows.join(by_text, ["k0", "k1"], "left").select(
        F.col("id").alias(id_col), *[F.coalesce(f"n_{kind}", F.lit(0)).alias(f"n_{kind}") for kind in BASE],
        F.sha2(F.coalesce(_listed(F.col("base")), F.lit("")), 256).alias("base_sha256"), F.coalesce(_listed(F.col("all")), F.lit("")).alias("spans"),
    )


def _pieces(found: DataFrame) -> DataFrame:
    """(k0, k1, cuts) with what redact() cuts: for each chunk that spans touch, in order, [from, to) within it and whether a mark stands there.

    Spans that touch or overlap are first joined, so that they share one mark, at their beginning.
    """
    order = Window.partitionBy("k0", "k1").orderBy("start", "stop")
    ended = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = found.withColumn("no", F.sum(F.when(F.col("start") <= ended, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = opened.groupBy("k0", "k1", "no").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    parts = whole.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / CHUNK), F.floor((F.col("stop") - 1) / CHUNK))))
    begin = F.col("chunk") * CHUNK
    inside = F.struct(
        F.greatest(F.col("start") - begin, F.lit(0)).cast("int").alias("a"), F.least(F.col("stop") - begin, F.lit(CHUNK)).cast("int").alias("b"),
        (F.col("start") >= begin).alias("marked"),
    )
    by_chunk = parts.groupBy("k0", "k1", "chunk").agg(F.array_sort(F.collect_list(inside)).alias("cuts"))
    return by_chunk.groupBy("k0", "k1").agg(F.map_from_entries(F.collect_list(F.struct("chunk", "cuts"))).alias("cuts"))


def redact(df: DataFrame, text_col: str = "text", mark: str = "<secret>", scope: int = SCOPE) -> DataFrame:
    """df with every span but endpoints replaced by `mark` in the text; touching spans share one mark.

    Texts are searched once, and what was found is cut to the shared folder with the rows. Rows without a candidate then pass
    unshuffled; the others meet their spans by a 128-bit key of the text, so that equal texts are cleaned alike, and are
    rebuilt chunk by chunk, in time that grows with the text and its spans however long it is. Null and empty texts stay as they
    are; repeated rows come back as often as they came; an empty table gives an empty result; all columns of df come back
    untouched, whatever their names.
    """
    names = df.columns
    rows = cut(df.select(F.struct(*[F.col(f"`{x}`") for x in names]).alias("row"), found_runs(F.col(text_col)).alias("found")))
    keys = [k.alias(f"k{i}") for i, k in enumerate(text_key(F.col(f"row.`{text_col}`")))]
    flagged = rows.where("size(found) > 0").select("row", "found", *keys)
    found = linked(flagged.select("k0", "k1", "found"), scope).where(F.col("kind") != KINDS.index("endpoint")).select("k0", "k1", "start", "stop")
    joined = flagged.drop("found").join(cut(_pieces(found)), ["k0", "k1"], "left")
    step = lambda chunk: lambda acc, x: F.struct(
        F.concat(acc["out"], F.substring(chunk, acc["pos"] + 1, x["a"] - acc["pos"]), F.when(x["marked"], F.lit(mark)).otherwise("")).alias("out"), x["b"].alias("pos"),
    )
    rest = lambda chunk: lambda acc: F.concat(acc["out"], F.substring(chunk, acc["pos"] + 1, F.lit(CHUNK)))
    clean = lambda chunk, no: F.coalesce(F.aggregate(F.element_at("cuts", no.cast("long")), F.struct(F.lit("").alias("out"), F.lit(0).alias("pos")), step(chunk), rest(chunk)), chunk)
    text = F.col(f"row.`{text_col}`")
    cleaned = F.when(F.col("cuts").isNull(), text).otherwise(F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), clean), ""))
    back = lambda d, column: d.select(*[(column if x == text_col else F.col(f"row.`{x}`")).alias(x) for x in names])
    return back(rows.where("size(found) = 0"), text).unionByName(back(joined, cleaned))
