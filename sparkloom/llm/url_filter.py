"""URL filters: fixed rules first, then association rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "\x00block"  # no URL token holds this character


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for a null or a text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_match(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none fits. ``rules``: (verdict, host/path)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of host and path that are no plain numbers."""
    words = F.split(F.concat_ws("/", host, path), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.rlike(r"^\p{N}+$")))


def word_classes(sets: DataFrame, least: float, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """Tokens that are rules by themselves, and the class of each other token that may be part of one.

    ``sets``: distinct (tokens, bad) with their number n. Only tokens of ``least`` blocked URLs can be part of a rule.
    One of enough confidence is a rule, and no combination with it is a smaller one. Of the others, those that stand in
    exactly the same URLs can't be told apart by any combination: they form a class, named by its first token.
    """
    each = sets.select(F.explode("tokens").alias("token"), "bad", "n", F.xxhash64("tokens", "bad").alias("h"), F.hash("bad", "tokens").cast("long").alias("g"))
    count = each.groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("hit"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"), F.count("*").alias("kinds"))
    count = count.where(F.col("hit") >= least)
    alone = F.col("hit") >= min_confidence * F.col("n")
    same = ("n", "hit", "h", "g", "kinds")
    rest = count.where(~alone)
    named = rest.groupBy(*same).agg(F.min("token").alias("class"))
    return count.where(alone).select("token"), rest.join(named, list(same)).select("token", "class")


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rules, as (rule_id, need), and their index, as (rule_id, token, part): a rule fits a URL with a token of each part.

    ``labelled``: tokens, label. FP-growth mines the combinations that go with label block; they are pruned by support
    and confidence, and of those within another such combination only the smaller is kept, as it fits wherever the larger
    one does. What can't be part of such a combination, or is one already, is taken out of the URLs before they are mined
    (see ``word_classes``), and so is what says the same: else a single long URL that stands often would give a
    combination for each subset of its tokens.
    """
    sets = labelled.groupBy(F.array_sort("tokens").alias("tokens"), (F.col("label") == "block").alias("bad")).agg(F.count("*").alias("n"))
    sets = scratch.save(sets, "token-sets")
    total = sets.agg(F.sum("n").alias("n")).first().n or 0
    least = max(1, math.ceil(min_support * total - 1e-9))
    single, part = word_classes(sets, least, min_confidence)
    single, part = scratch.save(single, "single"), scratch.save(part, "parts")
    index = single.select(F.sha2("token", 256).alias("rule_id"), "token", F.col("token").alias("part"))
    if part.isEmpty():
        return index.select("rule_id", F.lit(1).alias("need")), index
    words = sets.select("tokens", "bad", "n", F.explode("tokens").alias("token")).join(part, "token")
    words = words.groupBy("tokens", "bad", "n").agg(F.collect_set("class").alias("items"))
    words = words.select("items", "bad", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    items = words.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(LABEL)))).otherwise(F.col("items")).alias("items"))
    items = scratch.save(items, "items")
    left = items.count()  # URLs of which nothing is left aren't among them, so support is counted in URLs
    if left < least:
        return index.select("rule_id", F.lit(1).alias("need")), index
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / left, minConfidence=min_confidence).fit(items).associationRules
    found = found.where((F.size("consequent") == 1) & (F.col("consequent")[0] == LABEL))
    found = scratch.save(found.select(F.array_sort("antecedent").alias("parts")), "found")
    smaller = found.select(F.col("parts").alias("less"))
    inside = (F.size("less") < F.size("parts")) & (F.size(F.array_intersect("less", "parts")) == F.size("less"))
    # a rule holds its own parts, so looking for subsets by one part loses none
    pairs = found.select("parts", F.explode("parts").alias("t")).join(smaller.select("less", F.explode("less").alias("t")), "t").where(inside)
    kept = found.join(pairs.select("parts").distinct(), "parts", "left_anti").withColumn("rule_id", F.sha2(F.concat_ws("\x01", "parts"), 256))
    kept = scratch.save(kept, "rules")
    spread = kept.select("rule_id", F.explode("parts").alias("class")).join(part, "class").select("rule_id", "token", F.col("class").alias("part"))
    rules = index.select("rule_id", F.lit(1).alias("need")).unionAll(kept.select("rule_id", F.size("parts").alias("need")))
    return rules, index.unionAll(spread)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None, url_col: str = "url", min_support: float = 0.005, min_confidence: float = 0.9, default: str = "allow", broadcast_rules: int = 50_000, broadcast_bytes: int = 8 << 20, scratch: Scratch | None = None) -> DataFrame:
    """Adds host, path, rule, verdict and mined (the mined rules that fit) to each row of ``pages``.

    A fixed rule decides where one fits. Other URLs are blocked if a mined rule fits and get ``default`` else.
    ``labels`` has ``url`` and ``label`` (block or another); without it, the URLs that fixed rules block are labelled so,
    and all others count against a combination. Mined rules meet the URLs by an inverted index: token -> rules, and a
    rule fits when all its parts were met. The index is broadcast up to ``broadcast_rules`` entries and
    ``broadcast_bytes`` bytes (both counted) and shuffled beyond; both ways give the same. Null URLs have
    empty host and path and get ``default``; columns of the names above, in upper or lower case, are replaced; repeated
    rows are judged alike; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    new = ("host", "path", "rule", "verdict", "mined")
    src = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in new or c == url_col])
    host, path = url_parts(F.col(f"`{url_col}`"))
    # what is made here stands in one struct until the end, so that it meets no column of the user's
    taken = {c.lower() for c in src.columns}
    own = next(x for x in ("loom", *(f"loom{i}" for i in range(len(taken) + 1))) if not any(c.startswith(x) for c in taken))
    rule, verdict = rule_match(F.col(f"{own}.host"), F.col(f"{own}.path"), rules)
    base = src.withColumn(own, F.struct(host.alias("host"), path.alias("path")))
    base = base.withColumn(own, F.struct(f"{own}.host", f"{own}.path", rule.alias("rule"), verdict.alias("verdict"), url_tokens(F.col(f"{own}.host"), F.col(f"{own}.path")).alias("tokens")))
    made = base.select(f"{own}.*")
    if labels is None:
        known = made.select("tokens", F.coalesce("verdict", F.lit("unknown")).alias("label"))
    else:
        h, p = url_parts(F.col("url"))
        known = labels.select(url_tokens(h, p).alias("tokens"), "label")
    found, index = mine_rules(known.where(F.size("tokens") > 0), min_support, min_confidence, scratch)
    found, index = scratch.save(found, "mined"), scratch.save(index, "index")
    size = index.limit(broadcast_rules + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length("token") + F.octet_length("part") + 100).alias("bytes")).first()
    small = size.n <= broadcast_rules and (size.bytes or 0) <= broadcast_bytes
    # URLs with the same tokens share one lookup
    open_ = made.where(F.col("verdict").isNull()).select("tokens").distinct()
    open_ = open_.select("tokens", F.explode("tokens").alias("token"))
    met = open_.join(F.broadcast(index) if small else index, "token").select("tokens", "rule_id", "part").distinct()
    met = met.groupBy("tokens", "rule_id").agg(F.count("*").alias("have"))
    met = met.join(F.broadcast(found) if small else found, "rule_id").where("have = need")
    hits = scratch.save(met.groupBy("tokens").agg(F.array_sort(F.collect_set("rule_id")).alias("mined")), "hits")  # so that a common token set's rows can be split
    hits = hits.select(F.col("tokens").alias(f"{own}_tokens"), F.col("mined").alias(f"{own}_mined"))
    out = base.join(hits, F.col(f"{own}.tokens") == F.col(f"{own}_tokens"), "left")
    fits = F.when(F.col(f"{own}.rule").isNull(), F.col(f"{own}_mined"))
    return out.select(
        *[F.col(f"`{c}`") for c in src.columns if c.lower() not in new],
        F.col(f"{own}.host").alias("host"),
        F.col(f"{own}.path").alias("path"),
        F.col(f"{own}.rule").alias("rule"),
        F.coalesce(F.col(f"{own}.verdict"), F.when(F.col(f"{own}_mined").isNotNull(), "block").otherwise(default)).alias("verdict"),
        fits.alias("mined"),
    )
