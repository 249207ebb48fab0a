"""URL rules looked up in Bloom filter cascades, in DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, small

BITS_PER_KEY, HASHES = 10, 4
#: Bits a level may have (16 MB), some millions of listed keys; a longer list is refused.
MOST_BITS = 1 << 27


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


class Cascade:
    """Bloom filters in turn: the first holds the listed keys, each next one the keys that the one before passes wrongly.

    Over the keys of ``universe`` membership is exact: a key is listed if the number of levels it passes before the
    first that it fails is odd. Levels are bitmaps of at most MOST_BITS bits, held as binary literals.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame):
        self.levels: list[tuple[bytes, int]] = []
        inside, outside = listed, None
        level, keys = 0, universe.agg(F.approx_count_distinct("key")).first()[0]
        while True:
            bitmap = self._bitmap(inside, level, 0 if level else keys)
            if bitmap is None:
                return
            self.levels.append(bitmap)
            if outside is None:
                passed = universe.filter(self._passes(F.col("key"), 0)).distinct()
                outside = save(passed.join(small(listed), "key", "left_anti"), "passed")
            else:
                outside = save(outside.filter(self._passes(F.col("key"), level)), "passed")
            inside, outside = outside, inside
            level += 1

    def _bitmap(self, keys: DataFrame, level: int, universe: int = 0) -> tuple[bytes, int] | None:
        n = keys.count()
        if not n:
            return None
        # The first level is wide enough to let pass about as many wrong keys as there are listed ones.
        per_key = max(BITS_PER_KEY, HASHES * (universe / n) ** (1 / HASHES))
        bits = max(64, 8 * int((n * per_key + 7) // 8))
        if bits > MOST_BITS:
            raise ValueError(f"{n} keys need {bits} bits, over {MOST_BITS}")
        at = F.explode(F.array(*[self._place(F.col("key"), level, k, bits) for k in range(HASHES)])).alias("bit")
        # One row for each byte of the bitmap, so its size bounds what comes back.
        words = keys.select(at).select((F.col("bit") / 8).cast("long").alias("byte"), F.expr("1 << cast(bit % 8 as int)").alias("v"))
        out = bytearray(bits // 8)
        for r in words.groupBy("byte").agg(F.bit_or("v").alias("v")).collect():
            out[r.byte] = r.v
        return bytes(out), bits

    @staticmethod
    def _place(key: Column, level: int, k: int, bits: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(level * HASHES + k)), F.lit(bits).cast("long"))

    def _passes(self, key: Column, level: int) -> Column:
        data, bits = self.levels[level]

        def bit(k: int) -> Column:
            at = self._place(key, level, k, bits)
            byte = F.conv(F.hex(F.substring(F.lit(data), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, (at % 8).cast("int")) == 1

        return reduce(lambda a, b: a & b, [bit(k) for k in range(HASHES)])

    def has(self, key: Column) -> Column:
        """Whether ``key`` is listed; exact for the keys of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self._passes(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], *, url_col: str = "url", default: str = "allow", keep: tuple[str, ...] = ()
) -> DataFrame:
    """The rule and verdict of every row's URL.

    ``rules`` has (verdict, host, path). A rule fits its host and the subdomains, if the URL's path starts with the
    rule's; the longest that fits (host and path together, then host) decides. Where none fits the verdict is
    ``default``, since a URL that no list names is not held back.

    A URL has one candidate key for each pair of lengths that the rules' hosts and paths have. All candidates of the
    table are the key universe of two cascades, one for each verdict.

    Returns the ``keep`` columns, host, path, rule and verdict. Null URLs and those without :// have empty host and
    path and get ``default``; repeated rows are judged alike; an empty table gives no rows.
    """
    spark: SparkSession = pages.sparkSession
    urls = pages.select(*[F.col(c) for c in keep], url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    shapes = sorted({(len(h), len(p)) for _, h, p in rules}, key=lambda s: (-(s[0] + s[1]), -s[0]))

    def candidate(h: int, p: int) -> Column:
        host, path = F.col("host"), F.col("path")
        ends = (F.length(host) == h) | (F.substring(host, -(h + 1), 1) == ".")
        return F.when((F.length(host) >= h) & (F.length(path) >= p) & ends, F.concat(F.substring(host, -h, h), F.substring(path, 1, p)))

    if not rules:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = urls.select(F.explode(F.array(*[candidate(*s) for s in shapes])).alias("key")).filter(F.col("key").isNotNull())
    cascades = {}
    for verdict in sorted({v for v, _, _ in rules}):
        listed = spark.createDataFrame(sorted({(h + p,) for v, h, p in rules if v == verdict}), "key string")
        cascades[verdict] = Cascade(listed, keys)
    rule, verdict = F.lit(None).cast("string"), F.lit(default)
    for shape in reversed(shapes):
        key = candidate(*shape)
        for v, cascade in cascades.items():
            hit = key.isNotNull() & cascade.has(key)
            rule, verdict = F.when(hit, key).otherwise(rule), F.when(hit, F.lit(v)).otherwise(verdict)
    return urls.withColumns({"rule": rule, "verdict": verdict})
