"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A document's terms are its words, weighted by their counts. For each of SAMPLES samples a term k of weight S draws
r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1) from hashes of the term, takes t = floor(ln S / r + b) and the value
ln a = ln c - r (t - b + 1); the sample is the term and step of the least value. As the value is a function of term
and step, two documents share it exactly when they share both, which happens with the probability of their generalised
Jaccard similarity, sum of min / sum of max. A sample is stored as 15 bits of a hash of that value.

A text without words has samples of its own kind: it is like any other such text (1.0) and unlike all else. A null text
is empty. Documents are in descending order of id, nulls last; rows that repeat an id follow each other by a hash of
the text, and many of them are dealt to several tasks by that hash. Very long texts only give more terms. Input columns
but the id and the text aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _shared

SAMPLES = 64
SEED = 11
#: Samples worked out in one row, and those held by one 64-bit word.
AT_ONCE, IN_WORD = 4, 4
#: Ranges of ids taken from quantiles; more buckets cut these evenly.
RANGES = 4096
#: Rows of guests that may be sent to all tasks.
MOST_SENT = 100_000
#: A sample of a text without words.
_NONE = 0xFFFF


def _draws(first: Column, i: int) -> tuple[Column, Column, Column]:
    """r, ln c and b of a term for sample first + i, from two 64-bit hashes."""
    x, y = (F.xxhash64("_term", first * 2 + F.lit(2 * i + k + SEED)) for k in (0, 1))

    def uniform(h: Column, shift: int, bits: int) -> Column:
        part = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1))
        return (part + F.lit(0.5)) / F.lit(float(1 << bits))

    r = -F.log(uniform(x, 0, 32) * uniform(x, 32, 32))
    return r, F.log(-F.log(uniform(y, 0, 22) * uniform(y, 22, 21))), uniform(y, 43, 21)


def _words(text: Column) -> Column:
    """The words of a text, perhaps with empty strings among them; at least one string."""
    return F.split(text, "[\\x20\\x09-\\x0D]+")


def in_ranges(docs: DataFrame, n: int) -> DataFrame:
    """docs (_id, _text) with _ord, _hash, _bucket and _guest, in about n buckets that follow each other by descending
    id and then the text's hash; each bucket also holds, as a guest, the document that comes next after its last.
    """
    spark = docs.sparkSession
    ordered = docs.withColumns(
        {"_ord": F.coalesce(F.col("_id").cast("long"), F.lit(-(1 << 63))), "_hash": F.xxhash64("_text")}
    )
    ranges = min(n, RANGES)
    shares = [(k + 1) / ranges for k in range(ranges)]
    found = ordered.agg(
        F.min("_ord").alias("least"),
        F.percentile_approx("_ord", shares, max(10_000, 20 * ranges)).alias("tops"),
        F.max("_ord").alias("most"),
    ).first()
    tops = [*(found["tops"] or [0])[:-1], found["most"] or 0]
    # an id that is the top of several ranges has many rows, which are told apart by their hash
    unique = sorted(set(tops))
    bottoms = [(found["least"] or 0) - 1, *unique[:-1]]

    def listed(values: list, kind: str) -> Column:
        return F.array(*[F.lit(v).cast(kind) for v in values])

    at = F.size(F.filter(listed(unique, "long"), lambda t: t < F.col("_ord")))
    ordered = ordered.withColumn("_at", at)
    pick = lambda values, kind: F.element_at(listed(values, kind), F.col("_at") + 1)
    often = pick([tops.count(t) for t in unique], "long")
    top, width = pick(unique, "long"), pick([float(t) - b for t, b in zip(unique, bottoms, strict=True)], "double")
    share = F.shiftrightunsigned("_hash", 11) / F.lit(float(1 << 53))
    # positive for the lowest hash first: hashes are ordered as signed numbers
    share = F.when(F.col("_hash") < 0, share - 0.5).otherwise(share + 0.5)
    more = -(-n // ranges)
    low = often + F.floor((top.cast("double") - F.col("_ord").cast("double")) / width * more)
    part = F.when(F.col("_ord") == top, F.floor(share * often)).otherwise(low)
    ordered = ordered.withColumn(
        "_bucket", (F.lit(len(unique)) - F.col("_at")) * F.lit(1 << 24).cast("long") + part
    ).drop("_at")

    # a row for each bucket: its first document, which is the guest of the bucket before
    first = F.min(F.struct(F.bitwise_not("_ord").alias("neg"), F.col("_hash").alias("hash")))
    heads = _shared.staged(ordered.groupBy("_bucket").agg(first.alias("first")), "print-heads")
    each = heads.select("_bucket", F.bitwise_not("first.neg").alias("_ord"), F.col("first.hash").alias("_hash"))
    lead = Window.orderBy("_bucket")
    start = each.agg(F.min_by(F.struct("_ord", "_hash"), "_bucket").alias("start"))
    guests = each.select(
        F.col("_bucket").alias("_to"), F.lead(F.struct("_ord", "_hash")).over(lead).alias("g")
    ).crossJoin(F.broadcast(start))
    guests = guests.withColumn("g", F.coalesce("g", "start")).select("_to", "g._ord", "g._hash")
    # a row for each bucket; with very many buckets the rows are joined by their keys instead
    guests = F.broadcast(guests) if n <= MOST_SENT else guests
    visits = ordered.join(guests, ["_ord", "_hash"]).dropDuplicates(["_to"])
    visits = visits.withColumn("_bucket", F.col("_to")).drop("_to").withColumn("_guest", F.lit(True))
    visits = _shared.staged(visits.select(*ordered.columns, "_guest"), "print-guests")
    return ordered.withColumn("_guest", F.lit(False)).unionByName(visits)


def fingerprint(
    docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", samples: int = SAMPLES
) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    Texts move once, to their range of ids; words, samples and neighbours are worked out there. `samples` is a multiple
    of AT_ONCE: the samples of a term are worked out in rows of so many.
    """
    if samples % AT_ONCE:
        raise ValueError(f"samples must be a multiple of {AT_ONCE}")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("_id"), _shared.text_or_empty(text_col).alias("_text"))
    parts = 4 * _shared.n_partitions(spark)
    ranged = in_ranges(texts, 2 * parts).repartition(parts, "_bucket")
    # guests come last: they stand below all of their bucket, or wrap around to the first document
    order = Window.partitionBy("_bucket").orderBy("_guest", F.desc("_ord"), "_hash")
    rows = ranged.select(
        "_bucket", "_guest", "_id", "_text", F.row_number().over(order).alias("_nth"), F.lead("_text").over(order).alias("_next")
    )
    n = F.length("_text")
    cut = F.floor(n / 3).cast("int")
    next_text = F.substring(F.coalesce("_next", F.lit("")), F.lit(1), cut)
    rows = rows.withColumns(
        {"n_chars": n.cast("long"), "_head": F.substring("_text", F.lit(1), n - cut), "_new": next_text}
    )
    rows = rows.withColumn("edited_sha256", F.when(~F.col("_guest"), F.sha2(F.concat("_head", "_new"), 256)))

    doc = ["_bucket", "_nth", "_guest", "_id", "n_chars", "edited_sha256"]
    # both texts have the words before the last white space of what they share; after it each has its own
    shared = F.regexp_extract("_head", "(?s)^.*[\\x20\\x09-\\x0D]", 0)
    rest = F.substring(F.col("_head"), F.length("_shared") + 1, F.length("_head"))
    split = rows.select("_bucket", "_nth", "_id", "_guest", "_text", "_head", "_new", shared.alias("_shared"))
    tail = F.substring(F.col("_text"), F.length("_head") + 1, F.length("_text"))
    edited = F.when(F.col("_guest"), F.lit("")).otherwise(F.concat(rest, "_new"))
    sides = [F.col("_shared"), F.concat(rest, tail), edited]
    listed = F.array(*[F.struct(F.lit(i).alias("side"), _words(t).alias("words")) for i, t in enumerate(sides)])
    sides = split.select("_bucket", "_nth", "_id", F.explode(listed).alias("_x"))
    sides = sides.select(
        "_bucket", "_nth", "_id", F.col("_x.side").alias("_side"), F.explode("_x.words").alias("_word")
    )
    # with the id among the keys, both readers of the dealt texts need the same columns, and share one exchange;
    # the empty string is a term without weight, which keeps texts without words
    real = F.col("_word") != ""
    terms = sides.groupBy("_bucket", "_nth", "_id", F.xxhash64("_word").alias("_term")).agg(
        F.sum(F.when(real & (F.col("_side") != 2), 1.0).otherwise(0.0)).alias("_w0"),
        F.sum(F.when(real & (F.col("_side") != 1), 1.0).otherwise(0.0)).alias("_w1"),
    )
    logs = [F.when(F.col(w) > 0, F.log(w)).alias(f"_l{s}") for s, w in enumerate(("_w0", "_w1"))]
    # a bucket's documents share most of their terms: the draws of a term are worked out once for all that have it
    users = F.collect_list(F.struct("_nth", "_l0", "_l1")).alias("_users")
    each = terms.select("_bucket", "_nth", "_term", *logs).groupBy("_bucket", "_term").agg(users)
    # a row for each term and AT_ONCE of its samples: the generated code stays small enough to be compiled
    firsts = F.explode(F.array(*[F.lit(j) for j in range(0, samples, AT_ONCE)])).alias("_first")
    each = each.select("*", firsts)
    draws = [
        c.alias(f"_{k}{i}") for i in range(AT_ONCE) for k, c in zip("rcb", _draws(F.col("_first"), i), strict=True)
    ]
    names = [f"_{k}{i}" for i in range(AT_ONCE) for k in "rcb"]
    each = each.select("_bucket", "_first", "_users", *draws).select(
        "_bucket", "_first", *names, F.explode("_users").alias("_u")
    )

    def value(i: int, s: int) -> Column:
        r, c, b = (F.col(f"_{k}{i}") for k in "rcb")
        return c - r * (F.floor(F.col(f"_u._l{s}") / r + b) - b + F.lit(1.0))

    least = each.groupBy("_bucket", F.col("_u._nth").alias("_nth"), "_first").agg(
        *[F.min(value(i, s)).alias(f"_m{s}_{i}") for s in (0, 1) for i in range(AT_ONCE)]
    )

    def symbol(column: str) -> Column:
        return F.when(
            F.col(column).isNull(), F.lit(_NONE).cast("long")
        ).otherwise(F.xxhash64(column).bitwiseAND(F.lit(0x7FFF)))

    def word(s: int, k: int) -> Column:
        out = F.lit(0).cast("long")
        for i in range(k * IN_WORD, (k + 1) * IN_WORD):
            out = F.shiftleft(out, 16).bitwiseOR(symbol(f"_m{s}_{i}"))
        return out

    per_row = AT_ONCE // IN_WORD
    words = least.select(
        "_bucket", "_nth", "_first", *[word(s, k).alias(f"_p{s}_{k}") for s in (0, 1) for k in range(per_row)]
    )
    n_words = samples // IN_WORD

    def picked(s: int, w: int) -> Column:
        return F.max(
            F.when(F.col("_first") == w // per_row * AT_ONCE, F.col(f"_p{s}_{w % per_row}"))
        ).alias(f"_f{s}_{w}")

    prints = words.groupBy("_bucket", "_nth").agg(*[picked(s, w) for s in (0, 1) for w in range(n_words)])
    after = Window.partitionBy("_bucket").orderBy("_nth")
    prints = prints.select("*", *[F.lead(f"_f0_{w}").over(after).alias(f"_f2_{w}") for w in range(n_words)])
    found = rows.select(*doc).where("NOT _guest").join(prints, ["_bucket", "_nth"])

    def near(a: int, b: int) -> Column:
        same = F.lit(0)
        for w in range(n_words):
            apart = F.col(f"_f{a}_{w}").bitwiseXOR(F.col(f"_f{b}_{w}"))
            for k in range(IN_WORD):
                same = same + (F.shiftrightunsigned(apart, 16 * k).bitwiseAND(F.lit(0xFFFF)) == 0).cast("int")
        return same / F.lit(float(samples))

    def written(a: int) -> Column:
        return F.lower(F.concat(*[F.lpad(F.hex(f"_f{a}_{w}"), 16, "0") for w in range(n_words)]))

    return found.select(
        F.col("_id").alias(id_col), "n_chars", "edited_sha256", written(0).alias("fingerprint"),
        written(1).alias("edited_fingerprint"), near(0, 1).alias("near_edited"), near(0, 2).alias("near_next"),
    )
