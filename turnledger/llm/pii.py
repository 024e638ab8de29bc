"""Information-theoretic sanitisation of personal data.

Four patterns find the protected values (emails, IP addresses, cards, phones). The corpus
then tells which other terms give a value away: a term that stands near a value is compared
with all documents that hold the term. With p(value | term) the share of those documents
in which the value stands near the term, -log2 p is what remains unknown of the value once the term
is read (its information content less its pointwise mutual information with the term).
Terms that leave at most ``generalise_bits`` unknown are generalised to a class, those that
leave at most ``remove_bits`` are removed, wherever they stand in the corpus. A pair counts
only if seen in ``min_contexts`` different contexts; one sighting, or one text copied, is no
estimate.

A term is a run of two or more letters, in lower case, of a white-space delimited token
that has neither digits nor "@" in it; so no term lies inside a protected value. The
context of a value is the nearest ``near`` terms on either side, up to the next candidate
of the same kind and at most ``reach`` characters away; so a value makes a bounded number
of pairs however long its text or frequent the value is.

Everything is column expressions; matches of a text stay in its row.

Defined results
    * A null text counts as empty and has no spans.
    * Rows that repeat an identifier or a text each get the result of their text.
    * Positions are code points, end exclusive. Spans of different kinds may overlap; in
      the sanitised text the first of them, by start, wins.
    * Other columns are not read by ``find``; ``sanitise`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnledger.llm.common import store, text_of

# Each pattern starts where the one before it ended or where no earlier start could match,
# and repeats possessively: the matches are the leftmost ones in time linear in the text.
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"(?<!\S)[^\s@0-9]*+[@0-9]\S*+|(\p{L}{2,}+)"
KINDS = ("email", "ip", "card", "phone")

NEAR = 6
REACH = 120
MIN_CONTEXTS = 2
GENERALISE_BITS = 1.0
REMOVE_BITS = 0.1
CHUNK = 64


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)

    def weighed(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + weighed(i))
    return F.when((n >= 13) & (n <= 19), total % 10 == 0).otherwise(False)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(value, F.lit(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _identity(kind: str, value: Column) -> Column:
    return {"email": F.lower(value), "ip": value}.get(kind, _digits(value))


def _total(lens: Column, first: Column, count: Column) -> Column:
    return F.aggregate(F.slice(lens, first, count), F.lit(0), lambda a, x: a + x)


def _chunks(n: Column) -> Column:
    return F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))


def _chunk_bases(lens: Column, n: Column) -> Column:
    """The sum of all elements before each chunk."""
    return F.aggregate(
        _chunks(n),
        F.array(F.lit(0)),
        lambda acc, c: F.array_append(
            acc, F.element_at(acc, -1) + _total(lens, c * CHUNK + 1, F.lit(CHUNK))
        ),
    )


def _prefix_sums(lens: Column, bases: Column, n: Column) -> Column:
    """Sums of the elements before each of the first n, by chunks: near linear for long
    arrays. ``bases`` must be a column of its own, so that it is made once."""
    rows = F.transform(
        _chunks(n),
        lambda c: F.transform(
            F.sequence(F.lit(0), F.least(F.lit(CHUNK - 1), n - 1 - c * CHUNK)),
            lambda k: F.get(bases, c) + _total(lens, c * CHUNK + 1, k),
        ),
    )
    return F.flatten(rows)


def _with_kind(df: DataFrame, kind: str, pattern: str, sign: str) -> DataFrame:
    """Add the column ``kind``: array of (kind, start, end, value, left, right)."""
    text = F.col("__text")
    some = F.contains(text, F.lit(sign)) if sign else F.regexp_like(text, F.lit(pattern))
    found = F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn("__raw", found)
    df = df.withColumn("__raw", F.when(F.size("__raw") > 0, F.col("__raw")))
    df = df.withColumn(
        "__gaps", F.when(F.col("__raw").isNotNull(), F.split(text, pattern, -1))
    )
    lens = F.zip_with("__gaps", "__raw", lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
    df = df.withColumn("__lens", lens)
    some, n = F.col("__raw").isNotNull(), F.size("__raw")
    df = df.withColumn("__bases", F.when(some, _chunk_bases(F.col("__lens"), n)))
    sums = _prefix_sums(F.col("__lens"), F.col("__bases"), n)
    df = df.withColumn("__sums", F.when(some, sums))

    def span(value, i):
        gap = F.get("__gaps", i)
        start = F.get("__sums", i) + F.length(gap)
        return F.struct(
            F.lit(kind).alias("kind"),
            start.alias("start"),
            (start + F.length(value)).alias("end"),
            _identity(kind, value).alias("value"),
            F.right(gap, F.lit(REACH)).alias("left"),
            F.left(F.get("__gaps", i + 1), F.lit(REACH)).alias("right"),
            value.alias("raw"),
        )

    spans = F.filter(F.transform("__raw", span), lambda s: _valid(kind, s["raw"]))
    none = F.expr(
        "cast(array() as array<struct<kind:string,start:int,end:int,value:string,"
        "left:string,right:string,raw:string>>)"
    )
    df = df.withColumn(kind, F.coalesce(spans, none))
    return df.drop("__raw", "__gaps", "__lens", "__bases", "__sums")


def terms(text: Column) -> Column:
    """The terms of a text in order, not yet in lower case."""
    return F.array_remove(F.regexp_extract_all(text, F.lit(TERM), F.lit(1)), "")


def _near_terms(left: Column, right: Column) -> Column:
    """The terms nearest a value; a token cut by the reach is left out."""
    whole_left = F.when(F.length(left) < REACH, left).otherwise(F.regexp_replace(left, r"^\S*", ""))
    whole_right = F.when(F.length(right) < REACH, right).otherwise(F.regexp_replace(right, r"\S*$", ""))
    lefts = F.slice(F.reverse(terms(F.lower(whole_left))), 1, NEAR)
    rights = F.slice(terms(F.lower(whole_right)), 1, NEAR)
    return F.concat(lefts, rights)


def _show(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def protected(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row, id, text_key, base (array of spans with their contexts)."""
    base = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        text_of(text_col).alias("__text"),
    )
    base = base.withColumn("text_key", F.sha2("__text", 256))
    for kind, pattern, sign in zip(KINDS, (EMAIL, IP, CARD, PHONE), ("@", ".", "", "+"), strict=True):
        base = _with_kind(base, kind, pattern, sign)
    return base.select("row", "id", "text_key", F.concat(*KINDS).alias("base"))


def disclosing_terms(
    base: DataFrame,
    texts: DataFrame,
    min_contexts: int = MIN_CONTEXTS,
    generalise_bits: float = GENERALISE_BITS,
    remove_bits: float = REMOVE_BITS,
) -> DataFrame:
    """Terms with the bits they leave unknown of some value and what to do with them.

    ``base`` is the stored frame of protected values, ``texts`` has the column text. The
    documents of every term are counted with a combine before the shuffle, which then has a
    row for each term and task.
    """
    near = base.filter(F.size("base") > 0).select("row", F.explode("base").alias("v"))
    near = near.select(
        "row",
        F.concat_ws(":", "v.kind", "v.value").alias("value"),
        _near_terms(F.col("v.left"), F.col("v.right")).alias("near"),
    )
    near = near.select(
        "row",
        "value",
        F.xxhash64("near").alias("context"),
        F.explode(F.array_distinct("near")).alias("term"),
    )
    seen = (
        near.groupBy("value", "term")
        .agg(
            F.count_distinct("row").alias("together"),
            F.count_distinct("context").alias("contexts"),
        )
        .filter(F.col("contexts") >= min_contexts)
    )
    seen = store(seen, "seen")
    among = _terms_of(texts).groupBy("term").agg(F.count(F.lit(1)).alias("texts"))
    # The share cannot pass 1: lower-casing may hide a term from the count in rare scripts.
    share = F.least(F.col("together") / F.col("texts"), F.lit(1.0))
    return (
        among.join(seen, "term")
        .withColumn("unknown_bits", -F.log2(share))
        .filter(F.col("unknown_bits") <= generalise_bits)
        .groupBy("term")
        .agg(F.min("unknown_bits").alias("unknown_bits"))
        .withColumn(
            "action", F.when(F.col("unknown_bits") <= remove_bits, "remove").otherwise("generalise")
        )
    )


def _terms_of(texts: DataFrame, *keep: str) -> DataFrame:
    """A row for each different term of a text, in lower case."""
    return texts.select(
        *keep, F.explode(F.array_distinct(terms(F.lower("text")))).alias("term")
    )


def _term_spans(texts: DataFrame, told: DataFrame) -> DataFrame:
    """(text_key, found): the spans of disclosing terms of each text that has some.

    Texts with a hit are found by a short hash; spans come from the text itself, so texts
    that share a hash by chance lose nothing and gain nothing.
    """
    hashed = texts.withColumn("mark", F.xxhash64("text"))
    revealed = _terms_of(hashed, "mark").join(told, "term").groupBy("mark").agg(
        F.collect_set(F.when(F.col("action") == "remove", F.col("term"))).alias("gone"),
        F.collect_set(F.when(F.col("action") != "remove", F.col("term"))).alias("wide"),
    )
    here = hashed.join(store(revealed, "revealed"), "mark")
    # Alternate pieces: tokens with digits or "@", letter runs, and everything between.
    piece = r"(?<!\S)[^\s@0-9]*+[@0-9]\S*+|\p{L}{2,}+|(?s)."
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, p):
        low = F.lower(p)
        kind = F.when(F.array_contains("gone", low), "term-removed").when(
            F.array_contains("wide", low), "term"
        )
        end = acc["at"] + F.length(p)
        shown = F.concat(acc["out"], F.lit(","), kind, F.lit(":"), acc["at"], F.lit(":"), end)
        return F.struct(end.alias("at"), F.coalesce(shown, acc["out"]).alias("out"))

    walked = F.aggregate(F.regexp_extract_all("text", F.lit(piece), F.lit(0)), start, step)
    found = F.split(F.substring(walked["out"], F.lit(2), F.length(walked["out"])), ",")
    spans = F.sort_array(
        F.transform(
            F.filter(found, lambda x: x != ""),
            lambda x: F.struct(
                F.split_part(x, F.lit(":"), F.lit(1)).alias("kind"),
                F.split_part(x, F.lit(":"), F.lit(2)).cast("int").alias("start"),
                F.split_part(x, F.lit(":"), F.lit(3)).cast("int").alias("end"),
            ),
        )
    )
    return here.select("text_key", spans.alias("found")).dropDuplicates(["text_key"])


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per document: id, text_key, base and found spans as (kind, start, end)."""
    base = store(protected(df, id_col, text_col), "protected")
    texts = df.select(text_of(text_col).alias("text")).select(
        F.sha2("text", 256).alias("text_key"), "text"
    )
    told = store(disclosing_terms(base, texts, **limits), "told")
    found = _term_spans(texts, told)
    slim = lambda s: F.struct(s["kind"], s["start"], s["end"])
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    return base.join(store(found, "found"), "text_key", "left").select(
        F.col("id").alias(id_col),
        "text_key",
        F.transform("base", slim).alias("base"),
        F.coalesce("found", none).alias("found"),
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col,
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.size("found").cast("long").alias("n_term"),
        F.sha2(_show(F.col("base")), 256).alias("base_sha256"),
        _show(F.concat("base", "found")).alias("spans"),
    )


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """The documents with every span replaced by its class; removed terms leave nothing."""
    found = find(df, id_col, text_col, **limits)
    spans = found.select("text_key", F.concat("base", "found").alias("__spans"))
    spans = spans.filter(F.size("__spans") > 0).dropDuplicates(["text_key"])
    here = df.withColumn("__key", F.sha2(text_of(text_col), 256))
    here = here.join(spans.withColumnRenamed("text_key", "__key"), "__key", "left")
    text = text_of(text_col)
    ordered = F.array_sort(
        "__spans",
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]),
    )

    def step(acc, s):
        label = F.when(s["kind"] == "term-removed", "").otherwise(
            F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        )
        upto = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        ahead = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(ahead, F.concat(acc["out"], upto, label)).otherwise(acc["out"]).alias("out"),
        )

    walked = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    rest = F.substring(text, walked["at"] + 1, F.length(text))
    clean = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(F.concat(walked["out"], rest))
    return here.withColumn(text_col, clean).select(*df.columns)
