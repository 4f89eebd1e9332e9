"""URL filters by a blocked Bloom filter and an exact hash join, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import renamed, stored

#: Bits for each entry, whatever the list, and bits that an entry sets in its block of 64: of the keys that aren't listed
#: about 1 in 100 pass.
BITS_PER_ENTRY, PROBES = 16, 4
#: Blocks that ride along as one array (8 MB, 4 million entries); those of a larger list are rows, met by block number.
BLOCKS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(after(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without a host's ``://``."""
    return F.regexp_extract(after(url), "^[^/?#]*([^?#]*)", 1)


def after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """A listed URL's key: no scheme, no ``www.``, no trailing slashes."""
    return F.concat(F.lit("="), F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))


def mask(key: Column) -> Column:
    """The bits that a key sets in its block."""
    h = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(PROBES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def blocks_of(keys: DataFrame, n: int) -> DataFrame:
    """The filter's blocks that have a bit set: ``at`` of ``n``, and its ``word``; a key's block is chosen by its hash."""
    return keys.groupBy(F.pmod(F.xxhash64("key"), F.lit(n)).alias("at")).agg(F.bit_or(mask(F.col("key"))).alias("word"))


def array_of(blocks: DataFrame, n: int) -> DataFrame:
    """All ``n`` blocks as one row with an array."""
    filled = F.map_from_entries(F.collect_list(F.struct("at", "word")))
    every = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    return blocks.agg(filled.alias("m")).select(
        F.transform(every, lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0).cast("long"))).alias("words")
    )


def possible(places: DataFrame, keys: Column | list[Column], listed: DataFrame) -> DataFrame:
    """``host, path, key`` of the keys (an array, or a list of columns) of each place that pass the blocked Bloom filter of the listed ones."""
    keys = F.array(*keys) if isinstance(keys, list) else keys
    each = places.select("host", "path", F.explode(F.array_compact(keys)).alias("key"))
    n = max(1, -(-listed.count() * BITS_PER_ENTRY // 64))
    blocks = blocks_of(listed.select("key"), n)
    at, bits = lambda key: F.pmod(F.xxhash64(key), F.lit(n)), mask
    if n <= BLOCKS:
        words = array_of(blocks, n).scalar()
        hit = lambda key: F.element_at(words, (at(key) + 1).cast("int")).bitwiseAND(bits(key)) == bits(key)
        return each.where(hit(F.col("key")))
    each = each.withColumn("at", at(F.col("key")))
    return each.join(blocks, "at").where(F.col("word").bitwiseAND(bits(F.col("key"))) == bits(F.col("key"))).select("host", "path", "key")


def listing(rules: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """What is listed, one row a ``key``: a rule's host and path, or a canonical URL's; ``rule, verdict, labels, length``."""
    out = rules.dropna(subset=["host", "path", "verdict"]).select(
        F.concat("host", "path").alias("key"),
        F.concat("host", "path").alias("rule"),
        "verdict",
        F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("length"),
    )
    if urls is not None:
        host, path = host_of(F.col("url")), path_of(F.col("url"))
        own = urls.dropna(subset=["url"]).where(host != "").select(canonical(host, path).alias("key"), F.lit("block").alias("verdict"))
        out = out.unionByName(own, allowMissingColumns=True)
    return out.groupBy("key").agg(*[F.max(c).alias(c) for c in ("rule", "verdict", "labels", "length")])


def judge(
    pages: DataFrame,
    rules: DataFrame,
    urls: DataFrame | None = None,
    url: str = "url",
) -> DataFrame:
    """Append ``host, path, rule, verdict`` to every page.

    ``rules`` (``host, path, verdict``) fit a host and all its subdomains if
    the page's path starts with theirs; the longest wins, and of equal ones
    ``block``. Pages without a rule are blocked if ``urls`` (``url``) lists
    their canonical URL, else allowed. Each page's possible keys, as many as
    the rules have shapes (labels of the host, length of the path) and its
    canonical URL, are looked up in the Bloom filter; those that pass meet the
    list in a hash join, a row for each different host and path, and the
    answers go back to the pages. A host and path that many pages share is one
    row up to there; adaptive execution splits that last join where it is hot.

    Null urls and those without ``://`` have an empty host and path and are
    allowed. Rows with nulls in a rule's host, path or verdict, and null listed
    urls, don't count; repeated ones count once. Columns of ``pages`` with the
    names of the result are replaced; repeated pages all stay; an empty table
    gives no rows, and without rules and urls every page is allowed.
    """
    listed = stored(listing(rules, urls))  # read four times below
    result = ["host", "path", "rule", "verdict"]
    base, names, _ = renamed(pages)
    text = F.coalesce(F.col(names[url]).cast("string"), F.lit(""))
    page = base.withColumns({"host": host_of(text), "path": path_of(text)})
    # Shapes: as many as rules' hosts have numbers of labels and paths lengths, not as the list has entries.
    shapes = [(r[0], r[1]) for r in listed.where("rule is not null").select("labels", "length").distinct().sort("labels", "length").collect()]
    parts = F.split("host", r"\.")
    every = F.arrays_zip(F.lit([s[0] for s in shapes] or [1]).alias("n"), F.lit([s[1] for s in shapes] or [1 << 30]).alias("m"))  # one literal
    fits = F.transform(
        every,
        lambda s: F.when(
            (F.size(parts) >= s["n"]) & (F.length("path") >= s["m"]),
            F.concat(F.array_join(F.slice(parts, -s["n"], s["n"]), "."), F.substr(F.col("path"), F.lit(1), s["m"])),
        ),
    )
    if urls is not None:
        fits = F.concat(fits, F.array(canonical(F.col("host"), F.col("path"))))
    places = page.where(F.col("host") != "").select("host", "path").distinct()
    hits = possible(places, fits, listed).join(listed.select("key", "rule", F.col("verdict").alias("told")), "key")
    ruled = F.struct(F.col("rule").isNotNull(), F.length("rule"), "rule")
    answers = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "told"), ruled).alias("__answer"))
    told = page.join(answers, ["host", "path"], "left").withColumns(
        {"rule": F.col("__answer")["rule"], "verdict": F.coalesce(F.col("__answer")["told"], F.lit("allow"))}
    )
    return told.select(*[F.col(n).alias(c) for c, n in names.items() if c.lower() not in result], *result)
