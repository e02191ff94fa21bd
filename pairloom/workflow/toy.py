"""Synthetic datasets: components, hubs, motif-planted sequences, scored pairs, label noise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import plant_motif, random_sequence
from ..operators.ordering import dense_index, first_rows
from ..operators.pairs import ConstraintError


@dataclass(frozen=True)
class ToyOptions:
    proteins: int = 200
    pairs: int = 1000
    components: int = 10
    profile: str = "balanced"
    min_length: int = 80
    max_length: int = 350
    positive_rate: float = 0.15
    label_noise: float = 0.05
    hub_rate: float = 0.05
    families: int = 12
    seed: int = 0
    most_candidates: int = 2_000_000

    def __post_init__(self) -> None:
        for wrong, message in [
            (self.components < 1 or self.proteins < 2 * self.components, "a component needs two proteins"),
            (not 0 < self.positive_rate < 1 or not 0 <= self.label_noise < 0.5, "rates out of range"),
            (not 12 <= self.min_length <= self.max_length, "lengths out of range"),
            (self.profile not in ("balanced", "skewed", "single_giant"), f"unknown profile {self.profile!r}"),
            (self.pairs < self.proteins - self.components, "too few pairs to connect the components"),
        ]:
            if wrong:
                raise ConstraintError(message)
        candidates = sum(n * (n - 1) // 2 for n in component_sizes(self))
        if candidates > self.most_candidates or candidates < self.pairs:
            raise ConstraintError(f"{candidates} candidate pairs, between {self.pairs} and {self.most_candidates} are allowed")


def component_sizes(o: ToyOptions) -> list[int]:
    """Even, falling as 1/rank, or one with half of all proteins."""
    weight = {"balanced": lambda i: 1.0, "skewed": lambda i: 1 / (i + 1), "single_giant": lambda i: float(o.components) if i == 0 else 1.0}[o.profile]
    w = [weight(i) for i in range(o.components)]
    sizes = [2 + int((o.proteins - 2 * o.components) * x / sum(w)) for x in w]
    for i in range(o.proteins - sum(sizes)):
        sizes[i % o.components] += 1
    return sizes


def _u(seed: int, *keys: Column | str) -> Column:
    """Uniform in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(2**52)).cast("double") + 0.5) / float(2**52)


def proteins(spark: SparkSession, o: ToyOptions) -> DataFrame:
    """(protein_id, component_id, is_hub, domains, sequence): the motif of each domain is written into the sequence."""
    bounds, start = [], 0
    for i, n in enumerate(component_sizes(o)):
        bounds.append((i, start, start + n))
        start += n
    table = F.broadcast(spark.createDataFrame(bounds, "component_id int, lo bigint, hi bigint"))
    base = spark.range(o.proteins).join(table, (F.col("id") >= F.col("lo")) & (F.col("id") < F.col("hi")))
    pick = lambda salt: F.floor(_u(o.seed, F.lit(salt), "id") * o.families).cast("int")
    rows = base.select(
        F.concat(F.lit("T"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("protein_id"), "component_id", (_u(o.seed, F.lit("hub"), "id") < o.hub_rate).alias("is_hub"),
        F.array_sort(F.array_distinct(F.array(pick("d1"), pick("d2")))).alias("domains"),
        (o.min_length + F.floor(_u(o.seed, F.lit("len"), "id") * (o.max_length - o.min_length + 1))).cast("int").alias("length"), "id",
    )
    motif = lambda d: random_sequence(F.lit(6), F.lit(o.seed), F.lit("motif"), d)
    sequence = random_sequence(F.col("length"), F.lit(o.seed), F.lit("seq"), F.col("id"))
    for i in (0, 1):  # at fixed thirds, so that two motifs never meet
        d = F.get("domains", F.lit(i))
        sequence = F.when(d.isNull(), sequence).otherwise(plant_motif(sequence, motif(d), F.floor(F.col("length") * (i + 1) / 3).cast("int") - 3))
    return rows.withColumn("sequence", sequence).drop("id", "length")


def pairs(members: DataFrame, o: ToyOptions) -> DataFrame:
    """(protein_a, protein_b, label, component_id, pair_relation, edge_type, latent_score, label_was_flipped).

    Pairs lie within components. A chain connects each component, the rest is a weighted sample without replacement
    (least exponential keys). The top share by latent score is positive, some labels are flipped, and each component of
    more than one pair keeps both labels.
    """
    m = members.drop("sequence")
    chain = F.row_number().over(W.partitionBy("component_id").orderBy("protein_id"))
    m = m.withColumn("place", chain)
    side = lambda s: m.select("component_id", *(F.col(c).alias(f"{c}_{s}") for c in ("protein_id", "is_hub", "domains", "place")))
    met = side("a").join(side("b"), "component_id").filter("place_a < place_b")
    shared = F.arrays_overlap("domains_a", "domains_b")
    partner = F.exists("domains_a", lambda x: F.exists("domains_b", lambda y: (x + y) % o.families == 0))
    relation = F.when(shared, "shared_domain").when(partner, "compatible_domains").otherwise("unrelated")
    rows = met.select(
        F.col("protein_id_a").alias("protein_a"), F.col("protein_id_b").alias("protein_b"), "component_id", relation.alias("pair_relation"),
        (F.col("place_b") - F.col("place_a") == 1).alias("in_chain"), (F.col("is_hub_a") | F.col("is_hub_b")).alias("hub"),
    )
    bonus = F.when(F.col("pair_relation") == "compatible_domains", 2.0).when(F.col("pair_relation") == "shared_domain", 1.0).otherwise(0.0)
    noise = F.sqrt(-2 * F.log(_u(o.seed, F.lit("n1"), "protein_a", "protein_b"))) * F.cos(2 * 3.141592653589793 * _u(o.seed, F.lit("n2"), "protein_a", "protein_b"))
    rows = rows.withColumn("latent_score", bonus + F.col("hub").cast("int") * 0.5 + 0.5 * noise)
    weight = F.when(F.col("hub"), 3.0).otherwise(1.0) * (1 + bonus)
    key = F.when(F.col("in_chain"), -1.0).otherwise(-F.log1p(-_u(o.seed, F.lit("w"), "protein_a", "protein_b")) / weight)
    chosen = first_rows(rows.withColumn("key", key), ["key", "protein_a", "protein_b"], o.pairs)
    ranked = dense_index(chosen, [F.desc("latent_score"), "protein_a", "protein_b"], "rank")
    clean = (F.col("rank") < round(o.pairs * o.positive_rate)).cast("int")
    flip = _u(o.seed, F.lit("flip"), "protein_a", "protein_b") < o.label_noise
    labelled = ranked.withColumn("label", F.when(flip, 1 - clean).otherwise(clean)).withColumn("label_was_flipped", flip)
    part = W.partitionBy("component_id")
    one_sided = (F.count(F.lit(1)).over(part) > 1) & (F.min("label").over(part) == F.max("label").over(part))
    best = F.row_number().over(part.orderBy(F.desc("latent_score"), "protein_a", "protein_b"))
    worst = F.row_number().over(part.orderBy("latent_score", "protein_a", "protein_b"))
    fixed = F.when(one_sided & (F.col("label") == 0) & (best == 1), 1).when(one_sided & (F.col("label") == 1) & (worst == 1), 0).otherwise(F.col("label"))
    edge = F.when(F.col("in_chain"), "connecting").when(F.col("hub"), "hub").otherwise("ordinary")
    return labelled.withColumn("fixed", fixed).select("protein_a", "protein_b", F.col("fixed").cast("int").alias("label"), "component_id", "pair_relation", edge.alias("edge_type"), "latent_score", "label_was_flipped")


def label_summary(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(W.partitionBy()))


def relation_summary(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("pair_relation").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("positive_rate"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(W.partitionBy()))
