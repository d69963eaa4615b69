"""URL rules held in a cascade of Bloom filters.

A rule is a host and a path, like ``example.net/en/``. It fits its host and all subdomains where the URL's path starts with the
rule's, wherever the rule's path ends, and always where that is empty; of the rules that fit the longest wins, of equally long ones the
greatest by its bytes. Each URL has candidate keys, its host suffixes with its path prefixes, and the
question is which of them are listed. Level 1 of a cascade encodes the listed keys; level 2 those unlisted keys of the whole
corpus that level 1 lets through by mistake; level 3 the listed keys that level 2 lets through; and so on until a level makes no
mistake. Over that key universe membership is exact, and judging a URL needs no join: the filters are literals of the plan.

The filters' size follows the list, not the corpus (the first level's rate of mistakes is set to about listed / unlisted keys).
It is checked: a list whose filters would exceed ``max_bits`` is matched by a semi-join instead, with the same result.
Only candidates with as many labels as the deepest rule at most, and with path prefixes as long as some rule's path, are formed, so a
URL of a million labels or folders costs what a short one does.

A null URL, or one without ``://``, has an empty host and path; a URL without a path has an empty path, which only rules without one fit.
Rules whose host holds a slash, or whose path starts otherwise than with one, fit no URL.
Repeated rows are judged alike. An empty table gives an empty table. Everything is DataFrame expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import written

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass
class Level:
    """One Bloom filter: 64-bit words by number, hash functions and bits."""

    words: dict[int, int]
    hashes: int
    bits: int
    seed: int

    def holds(self, key: Column) -> Column:
        """Whether all places of the key are set. The filter stands in the plan once, as one literal that the optimizer folds."""
        flat = F.split(F.lit(",".join(str(self.words.get(k, 0)) for k in range(self.bits // 64))), ",").cast("array<bigint>")
        places = F.array(*[self.place(key, i) for i in range(self.hashes)])
        return F.forall(places, lambda at: F.getbit(F.element_at(flat, (F.floor(at / 64) + 1).cast("int")), (at % 64).cast("int")) == 1)

    def place(self, key: Column, i: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(i)), F.lit(self.bits).cast("long"))


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    url = F.coalesce(pages[url_col], F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({_quoted(url_col)}, instr({_quoted(url_col)}, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.drop("host", "path").withColumns({"host": F.translate(host, A_TO_Z, A_TO_Z.lower()), "path": path})


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def candidates(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Host suffixes of at most so many labels, each with the path prefixes of those lengths."""
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(labels)), lambda n: F.call_function("substring_index", host, F.lit("."), -n))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    prefixes = F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(F.array_distinct(suffixes), lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def cascade(keys: DataFrame, listed: str, max_bits: int) -> list[Level] | None:
    """Levels for the keys (key, seen, and a boolean column of that name), exact over those seen; None beyond max_bits."""
    seen = keys.filter("seen")
    inside, outside = seen.filter(listed).select("key"), seen.filter(f"not {listed}").select("key")
    n, rest = inside.count(), outside.count()
    rate = min(0.5, math.sqrt(0.5) * n / rest) if rest else 0.5
    levels: list[Level] = []
    while n:
        hashes = max(1, round(-math.log2(rate)))
        bits = 64 * math.ceil(hashes * n / math.log(2) / 64)
        if sum(x.bits for x in levels) + bits > max_bits:
            return None
        level = Level({}, hashes, bits, len(levels))
        places = inside.select(F.explode(F.array(*[level.place(F.col("key"), i) for i in range(hashes)])).alias("at"))
        words = places.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
        level.words = {r.word: r.bits for r in words.collect()}  # at most max_bits / 64 rows
        levels.append(level)
        inside, outside = written(outside.filter(level.holds(F.col("key"))), "op7-level"), inside
        n, rate = inside.count(), 0.5
    return levels


def listed_by(levels: list[Level], key: Column) -> Column:
    """The first level that does not hold the key decides: an odd one encodes listed keys, an even one unlisted ones."""
    answer = F.lit(len(levels) % 2 == 1)
    for number in range(len(levels), 0, -1):
        answer = F.when(~levels[number - 1].holds(key), F.lit(number % 2 == 0)).otherwise(answer)
    return answer


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", max_bits: int = 1 << 20) -> DataFrame:
    """pages with host, path, rule and verdict. rules: (host, path, verdict 'allow' or 'block'); block wins where a rule is listed as both."""
    rules = rules.filter(~F.contains("host", F.lit("/")) & ((F.col("path") == "") | F.startswith("path", F.lit("/"))))  # so a key has one host and path
    rules = rules.select(F.concat("host", "path").alias("key"), F.col("verdict"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"))
    deep = rules.agg(F.max("labels"), F.collect_set("length")).first()
    rows = with_host_and_path(pages, url_col).drop("rule", "verdict")
    if deep[0] is None:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys_of = candidates(F.col("host"), F.col("path"), max(1, deep[0]), sorted(deep[1]))
    universe = rows.select(F.explode(keys_of).alias("key")).select("key", F.lit(True).alias("seen"), F.lit(False).alias("blocked"), F.lit(False).alias("allowed"))
    named = rules.select("key", F.lit(False), F.col("verdict") == "block", F.col("verdict") == "allow")
    keys = written(universe.union(named).groupBy("key").agg(F.max("seen").alias("seen"), F.max("blocked").alias("blocked"), F.max("allowed").alias("allowed")), "op7-keys")
    blocking = cascade(keys, "blocked", max_bits)
    allowing = cascade(keys, "allowed and not blocked", max_bits)
    if blocking is None or allowing is None:
        return judge_by_join(rows, keys, keys_of, default)
    best = F.reduce(
        F.transform(keys_of, lambda k: F.struct(k.alias("rule"), F.when(listed_by(blocking, k), F.lit("block")).when(listed_by(allowing, k), F.lit("allow")).alias("verdict"))),
        F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")),
        lambda a, b: F.when(b["verdict"].isNotNull() & (a["rule"].isNull() | (F.struct(F.length(b["rule"]), b["rule"]) > F.struct(F.length(a["rule"]), a["rule"]))), b).otherwise(a),
    )
    rows = rows.withColumn("_best", best)
    return rows.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce(F.col("_best.verdict"), F.lit(default))}).drop("_best")


def judge_by_join(rows: DataFrame, keys: DataFrame, keys_of: Column, default: str) -> DataFrame:
    """For lists beyond the filters' bound: the longest listed key of each (host, path), joined back."""
    listed = keys.filter("seen and (blocked or allowed)").select("key", F.when(F.col("blocked"), "block").otherwise("allow").alias("verdict"))
    places = rows.select("host", "path").distinct()
    found = places.withColumn("key", F.explode(keys_of)).join(listed, "key")
    best = found.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), F.col("key").alias("rule"), "verdict")).alias("_best"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select(*rows.columns, F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"))


#: The rules of the query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A few rules as literals of the plan, so that no Python runs on the executors."""
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
    return spark.range(1).select(F.inline(rows))
