r"""Operator 6, secret scans: character Markov models.

Three fixed patterns give the base spans. For the rest, every long token is scored by two first-order character models, one
of random strings and one of ordinary identifiers; the mean log-likelihood ratio per step decides. The models are counted
from a labelled sample by a DataFrame aggregate and passed on as one array of fixed size. No Python runs on executors.
The sample is the base matches and plain tokens of some documents, random strings over the alphabets that keys are written
in, and identifiers with digits put together from the documents' own words; `accuracy` measures on what was held out of it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run cut short by a later AKIA of the same run is even shorter: same spans as + and a length test
HEX = r"[0-9a-f]{32,}"

LONG_TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
BLOCK = 256
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
KINDS = ("assign", "access", "hex", "random")


def found(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as array<struct<start, stop, value>>, positions in code points.

    The pieces between matches and the matches themselves, laid end to end, are the text; running lengths are positions.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,stop:int,value:string>>")

    def walk(laid: Column, at: Column) -> Column:
        return F.aggregate(
            laid,
            F.struct(at.alias("at"), none.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(x["gap"])).alias("start"),
                            (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("stop"),
                            x["hit"].alias("value"),
                        )
                    ),
                ).alias("out"),
            ),
        )

    # An array that grows match by match is copied each time, so blocks of matches are walked one by one and flattened.
    whole = F.arrays_zip(pieces.alias("gap"), hits.alias("hit"))
    begin = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), "array<array<struct<start:int,stop:int,value:string>>>").alias("out"))

    def blocks(acc: Column, laid: Column) -> Column:
        # one inner walk, made once and read twice
        inner = F.transform(F.array(acc["at"]), lambda at: walk(laid, at))
        return F.element_at(F.transform(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(acc["out"], F.array(i["out"])).alias("out"))), 1)

    cut = F.transform(
        F.array(whole),
        lambda w: F.transform(F.sequence(F.lit(0), ((F.size(w) - 1) / BLOCK).cast("int")), lambda b: F.slice(w, b * BLOCK + 1, F.lit(BLOCK))),
    )
    found_all = F.aggregate(F.element_at(cut, 1), begin, blocks, lambda acc: F.flatten(acc["out"]))
    return F.when(text.rlike(pattern), found_all).otherwise(none)


def random_strings(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """value: `n` random strings of 16 to 48 characters over the alphabets that keys are written in, alike at every call."""
    text = F.concat_ws(":", F.lit(seed), F.col("id"))
    hexes = F.sha2(text.cast("binary"), 512)
    wide = F.base64(F.unhex(hexes))
    letters = F.regexp_replace(wide, "[+/=]", "")
    kinds = [wide, F.translate(wide, "+/", "-_"), letters, F.lower(letters), F.upper(letters), hexes, F.upper(hexes)]
    length = (F.lit(16) + F.pmod(F.xxhash64(text), F.lit(33))).cast("int")
    return spark.range(n).select(F.element_at(F.array(*kinds), (F.col("id") % len(kinds) + 1).cast("int")).substr(F.lit(1), length).alias("value"))


def identifiers(words: Column) -> Column:
    """Ordinary names with digits out of a text's words: paths, constants, order numbers, dates, versions, camel case, numbers."""

    def named(at: Column) -> Column:
        a, b, c = (F.element_at(words, (at + k).cast("int")) for k in range(3))
        h = F.pmod(F.xxhash64(a, b, c, at), F.lit(10**9))
        number, year = F.lpad(h.cast("string"), 9, "0"), (h % 40 + 1990).cast("string")
        date = F.concat_ws("-", year, F.lpad((h % 12 + 1).cast("string"), 2, "0"), F.lpad((h % 28 + 1).cast("string"), 2, "0"))
        forms = [
            F.concat_ws("-", a, year, number, b),
            F.concat_ws("_", F.upper(a), F.upper(b), F.upper(c), number),
            F.concat(F.lower(a), F.initcap(b), F.initcap(c), (h % 1000).cast("string")),
            F.concat_ws("/", a, b, F.concat_ws("-", c, date)),
            F.concat_ws("_", F.lower(a), F.lower(b), F.lower(c), F.concat(F.lit("v"), (h % 30).cast("string"))),
            F.concat(number, F.reverse(number), year),
            F.concat(F.lower(a), F.lower(b), (h % 100).cast("string")),
        ]
        return F.element_at(F.array(*forms), (h % len(forms) + 1).cast("int"))

    return F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(1), F.size(words) - 2, F.lit(7)), named)).otherwise(F.array().cast("array<string>"))


def ordered_strings(spark: SparkSession) -> DataFrame:
    """value: rules such as ----- and pieces of the alphabets in their order, of 16 to 48 characters."""
    rows = [*ALPHABET, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"]
    size = (F.col("id") + 16).cast("int")
    each = spark.range(33).select("id", F.explode(F.array(*map(F.lit, rows))).alias("row"))
    return each.select(F.repeat("row", F.lit(75)).substr(F.when(F.length("row") > 1, F.col("id") + 1).otherwise(1).cast("int"), size).alias("value"))


def labelled_sample(docs: DataFrame, sample_docs: int = 2000, random: int = 20_000) -> DataFrame:
    """(value, secret) from the `sample_docs` smallest doc_ids and `random` random strings.

    Secrets are the base matches and the random strings. Plain are the other tokens of 6 characters on, unless they have 16 and two
    digits between other characters and so may be either, `identifiers` made of the documents' words, and `ordered_strings`.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    last = ids.where("doc_id is not null").orderBy("doc_id").limit(sample_docs).agg(F.max("doc_id")).first()[0]  # ids alone travel
    some = docs.where(F.col("doc_id") <= F.lit(last).cast("long")).select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    secrets = F.concat(
        F.transform(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: v),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
    )
    tokens = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]{6,}"), F.lit(0))
    words = F.regexp_extract_all("text", F.lit(r"[A-Za-z]{2,12}"), F.lit(0))
    both = some.select(F.array_distinct(F.filter(secrets, lambda v: F.length(v) >= 8)).alias("yes"), tokens.alias("all"), words.alias("words"))
    rows = both.select("yes", F.array_distinct(F.array_except("all", "yes")).alias("no"), identifiers(F.col("words")).alias("made"))
    plain = F.filter("no", lambda v: (F.length(v) < 16) | ~v.rlike(r"[0-9].*[0-9]") | v.rlike(r"^[0-9]+$"))
    parts = [
        rows.select(F.explode(F.col("yes")).alias("value"), F.lit(True).alias("secret")),
        random_strings(docs.sparkSession, random).select("value", F.lit(True).alias("secret")),
        rows.select(F.explode(F.concat(plain, F.col("made"))).alias("value"), F.lit(False).alias("secret")),
        ordered_strings(docs.sparkSession).select("value", F.lit(False).alias("secret")),
    ]
    return reduce(DataFrame.unionByName, parts)


def held_out(sample: DataFrame, one_in: int = 5) -> tuple[DataFrame, DataFrame]:
    """(to fit, to measure): one value in `one_in` is held out, by its hash, wherever it stands."""
    aside = F.pmod(F.xxhash64(F.col("value"), F.lit("held out")), F.lit(one_in)) == 0
    return sample.where(~aside), sample.where(aside)


def accuracy(sample: DataFrame, model: list[float], threshold: float = 1.0, least: int = 16) -> DataFrame:
    """One row: n, n_secret, n_called, n_right, precision and recall over the distinct values of at least `least` characters."""
    called = sample.where(F.length("value") >= least).distinct().withColumn("called", log_ratio(F.col("value"), model) > threshold)
    right = F.count_if(F.col("called") & F.col("secret"))
    n_called, n_secret = F.count_if("called"), F.count_if("secret")
    return called.agg(
        F.count(F.lit(1)).alias("n"), n_secret.alias("n_secret"), n_called.alias("n_called"), right.alias("n_right"),
        F.try_divide(right, n_called).alias("precision"), F.try_divide(right, n_secret).alias("recall"),
    )


def _code(char: Column) -> Column:
    """Place in the alphabet from 1; 0 for any other character."""
    return F.position(char, F.lit(ALPHABET))


def ratios(sample: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of every step a -> b, row by row over the alphabet (0 stands for any other character)."""
    size = len(ALPHABET) + 1
    steps = sample.where(F.length("value") > 1).select(
        "secret", F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.col("value").substr(i, F.lit(2)))).alias("pair")
    )
    counts = (
        steps.select("secret", _code(F.col("pair").substr(1, 1)).alias("a"), _code(F.col("pair").substr(2, 1)).alias("b"))
        .groupBy("secret", "a", "b").count().collect()  # at most 2 * size * size rows
    )
    table = {True: [[0] * size for _ in range(size)], False: [[0] * size for _ in range(size)]}
    for r in counts:
        table[r.secret][r.a][r.b] = r["count"]

    def log_p(rows: list[list[int]]) -> list[list[float]]:
        whole = sum(map(sum, rows))
        ends = [(sum(r[b] for r in rows) + smoothing) / (whole + smoothing * size) for b in range(size)]
        # Steps are smoothed towards how often the second character occurs at all.
        return [[math.log((r[b] + 8 * ends[b]) / (sum(r) + 8)) for b in range(size)] for r in rows]

    yes, no = log_p(table[True]), log_p(table[False])
    return [yes[a][b] - no[a][b] for a in range(size) for b in range(size)]


def _weights(model: list[float]) -> Column:
    return F.expr("array(" + ",".join(f"{float(x)!r}D" for x in model) + ")")


def log_ratio(value: Column, model: list[float] | Column) -> Column:
    """Mean log-likelihood ratio per step; above 0 the model of random strings explains `value` better."""
    size = len(ALPHABET) + 1

    def scored(weights: Column) -> Column:
        codes = F.transform(F.split(value, ""), _code)
        steps = F.transform(
            F.sequence(F.lit(1), F.size(codes) - 1), lambda i: F.element_at(weights, F.element_at(codes, i) * size + F.element_at(codes, i + 1) + 1)
        )
        return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(codes) - 1, F.lit(1))

    return scored(model) if isinstance(model, Column) else F.element_at(F.transform(F.array(_weights(model)), scored), 1)


def scan(docs: DataFrame, model: list[float], threshold: float = 1.0) -> DataFrame:
    """Every document's secrets: doc_id, text and found: array<struct<start, stop, kind>> sorted by start, then kind.

    kind is the place in KINDS. Random strings that touch a base span are left out, since that span covers them.
    NULL text is empty; empty texts have no spans; rows are neither dropped nor merged, whatever their doc_id.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", "text",
        F.filter(found(F.col("text"), ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 8).alias("assign"),
        found(F.col("text"), ACCESS).alias("access"),
        found(F.col("text"), HEX).alias("hex"),
        found(F.col("text"), LONG_TOKEN).alias("tokens"),
    )
    fixed = F.concat(*[_of_kind(F.col(k), n) for n, k in enumerate(KINDS[:3])])
    known = base.withColumn("base", F.array_sort(fixed, _by_start))
    # The models come first: few tokens are left to be held against the base spans.
    scored = F.transform(F.array(_weights(model)), lambda w: F.filter("tokens", lambda t: log_ratio(t["value"], w) > threshold))
    random = F.when(F.size("tokens") > 0, F.element_at(scored, 1)).otherwise(F.col("tokens"))  # the weights are laid out once a row
    clear = F.filter(random, lambda t: ~F.exists("base", lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"])))
    more = _of_kind(clear, 3)
    return known.withColumn("found", F.array_sort(F.concat("base", more), _by_start)).drop("assign", "access", "hex", "tokens")


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _by_start(x: Column, y: Column) -> Column:
    left, right = x["start"] * 4 + x["kind"], y["start"] * 4 + y["kind"]
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    n = [_count(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return scanned.select("doc_id", *n, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))
