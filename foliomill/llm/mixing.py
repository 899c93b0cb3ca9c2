"""Problem 9: mixing sources to target weights.

Every document gets an Efraimidis-Spirakis key, log(u) / w with u a hash of the
document and w its quality weight; the largest keys are a weighted sample without
replacement. Within a source documents are ordered by key and taken until the
source's token budget is filled; complete epochs come before the fraction.

The prefix sums aren't taken over a source in one task: keys are first put into
equal bins, token sums per source and bin give the bin in which the budget ends,
and only that bin is ordered.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.llm.common import cut, map_batches
from foliomill.llm.quality import line_statistics

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Bins of keys of a source; two rounds of them leave 1 in BINS**2 rows to order.
BINS = 512
#: Tables with a row per target are broadcast up to so many targets; beyond, the planner
#: joins them by shuffle and splits the hot sources.
BROADCAST_TARGETS = 100_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The file of a public tokenizer; ``name`` may be a path of its own."""
    return name if "/" in name else str(Path("/opt/tokenizers") / name)


def _encoder(vocabulary: bytes) -> Callable[[str], int]:
    import base64

    import tiktoken

    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    encoding = tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def quality_weight(text: str) -> float:
    """A weight from 0.1 to 1: the share of common words and of letters."""
    f = line_statistics(text.replace("\n", " "))
    return 0.1 + 0.45 * min(1.0, f["common"] / 0.3) + 0.45 * min(1.0, f["letter_share"])


def sized_documents(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``source``, ``tokens``, ``weight`` of documents with text and source. The
    vocabulary, a file of fixed size, is read by the driver and sent to the executors."""
    sent = documents.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def make() -> Callable:
        count = _encoder(sent.value)

        def run(cols: dict[str, list]) -> dict[str, list]:
            texts = cols["text"]
            return {"doc_id": cols["doc_id"], "source": cols["source"], "tokens": [count(t) for t in texts], "weight": [quality_weight(t) for t in texts]}

        return run

    rows = documents.select("doc_id", "source", "text").where("source IS NOT NULL AND text IS NOT NULL AND text <> ''")
    return map_batches(rows, make, "doc_id bigint, source string, tokens bigint, weight double")


def budgets(sizes: list[tuple[str, int]], targets: list[tuple[str, float, int]]) -> tuple[float, dict[str, float]]:
    """(total, budget by source): the largest total of which every source can have its
    share without repeating its documents more than allowed.

    Sources without documents or with a share or repeats of zero can't contribute;
    the shares of the others are scaled to one."""
    have = dict(sizes)
    usable = [(s, w, r) for s, w, r in targets if s is not None and have.get(s, 0) > 0 and (w or 0) > 0 and (r or 0) > 0]
    weight = sum(w for _, w, _ in usable)
    if not usable:
        return 0.0, {}
    total = min(have[s] * r * weight / w for s, w, r in usable)
    return total, {s: total * w / weight for s, w, _ in usable}


def mixture(documents: DataFrame, targets: DataFrame, seed: int = 42, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id``, ``source``, ``tokens``, ``copies``: the documents of the mix and how
    often each is used, never more than ``max_repeats``.

    Documents without source, text or target are left out. A source's whole epochs
    use every document; the rest of its budget goes to the documents of largest key,
    the one that crosses the budget included if at least half of it fits. Equal keys
    are ordered by ``doc_id``.
    """
    sized = cut(sized_documents(documents, tokenizer_path(tokenizer)))
    goal = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.collect()]
    small = F.broadcast if len(goal) <= BROADCAST_TARGETS else lambda df: df
    have = [(r["source"], r["t"]) for r in sized.groupBy("source").agg(F.sum("tokens").alias("t")).join(targets.select("source").distinct(), "source").collect()]
    _, budget = budgets(have, goal)
    size = dict(have)
    if not budget:
        return sized.where("false").select("doc_id", "source", "tokens", F.lit(0).alias("copies"))
    repeats = {s: r for s, _, r in goal}
    plan = [(s, int(min(b // size[s], repeats[s])), float(b - size[s] * min(b // size[s], repeats[s]))) for s, b in sorted(budget.items())]
    plan_df = documents.sparkSession.createDataFrame(plan, "source string, epochs int, rest double")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = sized.join(small(plan_df), "source").withColumn("key", F.log(u) / F.col("weight"))
    # exp(key) is in (0, 1), so bins of it need no knowledge of the keys
    fine = F.floor(F.exp("key") * BINS * BINS)
    keyed = keyed.withColumn("bin", F.floor(fine / BINS)).withColumn("fine", fine)
    base = None
    for ends in (["bin"], ["bin", "fine"]):
        inside = keyed if base is None else keyed.join(small(base), ["source", "bin"])
        first = F.lit(0) if base is None else F.first("base")
        sums = inside.groupBy("source", *ends).agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"), first.alias("base"))
        order = Window.partitionBy("source", *ends[:-1]).orderBy(F.col(ends[-1]).desc()).rowsBetween(Window.unboundedPreceding, -1)
        run = sums.withColumn("before", F.col("base") + F.coalesce(F.sum("t").over(order), F.lit(0)))
        last = run.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") >= F.col("rest")))
        base = last.select("source", *ends, F.col("before").alias("base"))
    cutoff = base.select("source", F.col("bin").alias("last_bin"), F.col("fine").alias("last_fine"), "base")
    joined = keyed.join(small(cutoff), "source", "left")
    edge = joined.where(F.col("fine") == F.col("last_fine"))
    order = Window.partitionBy("source").orderBy(F.col("key").desc(), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("before", F.col("base") + F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    taken = edge.select("doc_id", "source", "tokens", "epochs", (F.col("before") + F.col("tokens") / 2 <= F.col("rest")).cast("int").alias("more"))
    others = joined.where(F.col("last_fine").isNull() | (F.col("fine") != F.col("last_fine")))
    above = (F.col("last_fine").isNotNull() & (F.col("fine") > F.col("last_fine"))).cast("int")
    whole = others.select("doc_id", "source", "tokens", "epochs", above.alias("more"))
    return whole.unionByName(taken).select("doc_id", "source", "tokens", (F.col("epochs") + F.col("more")).alias("copies")).where("copies > 0")


def mix_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """``source``, ``target_share``, ``documents``, ``tokens``, ``share``, ``most_copies``
    for every target; sources that gave nothing have zeros."""
    got = mix.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    total = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())
    joined = targets.join(got, "source", "left").withColumn("total", total)  # a row per target
    return joined.select(
        "source", "target_share", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
