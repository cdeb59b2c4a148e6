r"""Document fingerprints by a homomorphic multiset hash. DataFrame functions only.

The vector of a text is the sum of wide vectors, one for each paragraph (a line with something other than white space). So it does
not depend on the order of the paragraphs, and a paragraph is put in or taken out by one addition or subtraction (``added``, ``removed``)
without the rest of the text. The vector of a paragraph has

* EQUAL lanes of 60 bits from two SHA-256 digests, summed modulo 2^60: texts of the same paragraphs, and in practice only those, agree in them;
* the number of its pieces, and for each of LANES lanes the number of pieces whose MD5 digest has the bit of the lane set. A piece is a stretch of
  at most PIECE characters within a paragraph, cut at the ends of sentences. These sums, counted as +1 for a set bit and -1 for another (Alon, Matias,
  Szegedy, 1996), keep inner products: 2 u v / (u u + v v) estimates the share of common pieces, with an error of about
  sqrt(2 / LANES) = 0.13 for texts that have nothing in common.

Two lanes share a long, so no sum overflows in a text of less than 2^30 pieces.

Defined results: a null text is an empty one, whose vector is zero. Equal vectors have the likeness 1, a zero vector and another one 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EQUAL = 8
LANES = 120
PIECE = 128
PARAGRAPHS = r"[^\n]*[^\x20\x09-\x0D][^\n]*"
PIECES = rf"[^\n.!?]{{1,{PIECE}}}"
_MODULUS = 1 << 60
_HALF = 1 << 30
_PAIR = 1 | _HALF
_BUCKETS_A_PARTITION = 4


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _number(digest: Column, i) -> Column:
    """The i-th group of 15 hex digits."""
    return F.conv(F.substr(digest, 15 * i + 1, F.lit(15)), 16, 10).cast("long")


def _places(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _long() -> Column:
    return F.lit(0).cast("long")


def vector(text: Column) -> Column:
    """The vector of a text: EQUAL lanes, the number of pieces, and LANES / 2 longs of two lanes each."""
    text = F.coalesce(text, F.lit(""))
    paragraphs = F.regexp_extract_all(text, F.lit(PARAGRAPHS), F.lit(0))
    four = lambda d: F.transform(_places(4), lambda i: _number(d, i))
    digests = F.transform(paragraphs, lambda p: F.concat(_bound(F.sha2(p, 256), four), _bound(F.sha2(F.concat(F.lit("2"), p), 256), four)))
    total = lambda ds, i: F.aggregate(ds, _long(), lambda s, d: (s + F.get(d, i)).bitwiseAND(F.lit(_MODULUS - 1)))
    equal = _bound(digests, lambda ds: F.transform(_places(EQUAL), lambda i: total(ds, i)))

    digests = F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), lambda p: F.md5(p))
    step = lambda j: lambda s, h: s + F.call_function("shiftrightunsigned", h, j).bitwiseAND(F.lit(_PAIR))
    counted = lambda hs: F.transform(_places(30), lambda j: F.aggregate(hs, _long(), step(j)))
    lanes = lambda ds, i: _bound(F.transform(ds, lambda d: _number(d, F.lit(i))), counted)
    return F.concat(equal, _bound(digests, lambda ds: F.concat(F.array(F.size(ds).cast("long")), lanes(ds, 0), lanes(ds, 1))))


def _combined(u: Column, v: Column, sign: int) -> Column:
    both = F.zip_with(F.slice(u, 1, EQUAL), F.slice(v, 1, EQUAL), lambda a, b: F.pmod(a + sign * b, F.lit(_MODULUS)))
    rest = F.zip_with(F.slice(u, EQUAL + 1, 1 + LANES // 2), F.slice(v, EQUAL + 1, 1 + LANES // 2), lambda a, b: a + sign * b)
    return F.concat(both, rest)


def added(u: Column, v: Column) -> Column:
    """The vector of the paragraphs of both."""
    return _combined(u, v, 1)


def removed(u: Column, v: Column) -> Column:
    """The vector of the paragraphs of ``u`` without those of ``v``, all of which must be among them."""
    return _combined(u, v, -1)


def signed_lanes(u: Column) -> Column:
    """LANES sums of +1 and -1: of each pair of lanes the low half, then all high halves."""
    pieces, packed = F.get(u, F.lit(EQUAL)), F.slice(u, EQUAL + 2, LANES // 2)
    low = F.transform(packed, lambda x: 2 * x.bitwiseAND(F.lit(_HALF - 1)) - pieces)
    high = F.transform(packed, lambda x: 2 * F.shiftrightunsigned(x, 30) - pieces)
    return F.concat(low, high)


def likeness(u: Column, v: Column) -> Column:
    """1 for equal vectors, else the estimated share of common pieces, from 0 to 1."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), _long(), lambda s, x: s + x)
    both = F.array(F.struct(signed_lanes(u).alias("a"), signed_lanes(v).alias("b")))
    sums = F.get(F.transform(both, lambda t: F.struct((2 * dot(t["a"], t["b"])).alias("twice"), (dot(t["a"], t["a"]) + dot(t["b"], t["b"])).alias("norms"))), F.lit(0))
    share = _bound(sums, lambda s: F.when(s["norms"] > 0, F.greatest(F.lit(0.0), s["twice"] / s["norms"])).otherwise(F.lit(0.0)))
    return F.when(u == v, F.lit(1.0)).otherwise(share)


def encoded(u: Column) -> Column:
    """A vector as text: the lanes of equality in hex, the number of pieces, the signed lanes."""
    equal = F.transform(F.slice(u, 1, EQUAL), lambda x: F.lpad(F.lower(F.hex(x)), 15, "0"))
    counts = F.transform(signed_lanes(u), lambda x: x.cast("string"))
    return F.concat_ws(":", F.array_join(equal, ""), F.get(u, F.lit(EQUAL)).cast("string"), F.array_join(counts, ","))


def _bounds(rows: DataFrame) -> list:
    """The least key of each of several ranges of about as many rows each: few rows, a fixed number for each shuffle partition."""
    n = _BUCKETS_A_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("_key").repartitionByRange(n, "_key").withColumn("part", F.spark_partition_id())
    return sorted(r.k for r in dealt.groupBy("part").agg(F.min("_key").alias("k")).collect())


def _bucket(key: Column, bounds: list, kind: str) -> Column:
    """The number of the last bound that is not above the key, by halving."""
    table = F.array(*(F.struct(F.lit(b[0]), F.lit(b[1]).cast(kind), F.lit(b[2])) for b in bounds))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, (len(bounds) - 1).bit_length())))))
    down = lambda at, step: F.when((at + step < len(bounds)) & (F.get(table, at + step) <= key), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), down)


def neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text, vector, next_text, next_vector)``: every row with the row after it in the order of ids; the first follows the last.

    Rows of one id are in the order of a hash of their texts, null ids come first, null texts are empty. Of rows that are equal in both, each has
    the next one, and the last of them the row after. Texts are shuffled once, to ranges of the order; the first row of each range
    also goes to the range before it. A range is a share of the rows whatever their ids are, so one id may hold most of them; rows of
    one id and one text are in one range.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.col(id_col).isNotNull().alias("known"), F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), key.alias("_key"))
    bounds = _bounds(rows)
    if not bounds:
        empty = rows.select(F.col("_id").alias(id_col), F.col("_text").alias("text"), vector(F.col("_text")).alias("vector"))
        return empty.withColumns({"next_text": F.col("text"), "next_vector": F.col("vector")})
    firsts = F.array(*(F.struct(F.lit(b[0]), F.lit(b[1]).cast(kind), F.lit(b[2])) for b in bounds))
    rows = rows.withColumn("_at", _bucket(F.col("_key"), bounds, kind))
    own = F.struct(F.col("_at").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.when(F.col("_at") > 0, F.col("_at") - 1).otherwise(len(bounds) - 1).alias("bucket"), F.lit(True).alias("guest"))
    first = F.get(firsts, F.col("_at")).eqNullSafe(F.col("_key"))
    places = F.when(first, F.array(own, guest)).otherwise(F.array(own))
    dealt = rows.withColumn("_p", F.explode(places)).select("_id", "_text", "_key", "_p.bucket", "_p.guest").repartition("bucket")
    by = Window.partitionBy("bucket").orderBy("guest", "_key")  # one range of the order
    dealt = dealt.withColumn("_vector", vector(F.col("_text")))
    after = dealt.withColumns({"next_text": F.lead("_text").over(by), "next_vector": F.lead("_vector").over(by)}).where("not guest")
    return after.select(F.col("_id").alias(id_col), F.col("_text").alias("text"), F.col("_vector").alias("vector"), "next_text", "next_vector")
