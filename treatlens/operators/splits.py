"""Train / val / test splits that hold out whole contexts, and their audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treatlens import schema as S
from treatlens.functions import as_double, as_int, clean_text
from treatlens.operators.ordering import global_rank, hash_rank
from treatlens.session import broadcast_if_small, cut_lineage

N_BINS = 4

# Why a split departs from the asked fractions.
TWO_GROUPS = "insufficient_shift_groups_for_three_way_split"
ONE_GROUP = "single_shift_group_only_train_split_possible"
SMALL_PART = "undersized_partition_fallback_applied"
ALL_TRAIN = "dataset_too_small_for_holdout_all_assigned_to_train"


@dataclass(frozen=True)
class SplitSettings:
    """Fractions are shares of the groups, not of the cells."""

    seed: int = 42
    val_fraction: float = 0.15
    test_fraction: float = 0.15
    min_cells: int = 32

    def __post_init__(self) -> None:
        if self.seed < 0:
            raise ValueError("seed must not be negative")
        if not (0 <= self.val_fraction < 1 and 0 <= self.test_fraction < 1):
            raise ValueError("fractions must lie between 0 and 1")
        if self.val_fraction + self.test_fraction >= 1:
            raise ValueError("val and test fractions must leave room for training")
        if self.min_cells <= 0:
            raise ValueError("min_cells must be positive")


def group_by_column(cells: DataFrame, col: str) -> DataFrame:
    """(cell_id, group): the trimmed label of a category column."""
    if col not in cells.columns:
        raise ValueError(f"cells lack the column '{col}'")
    return cells.select("cell_id", clean_text(F.col(col)).alias("group"))


def require_groups(groups: DataFrame) -> None:
    """Error when any cell has an empty label."""
    if not groups.where(F.coalesce("group", F.lit("")) == "").isEmpty():
        raise ValueError("the grouping column holds empty values")


def _treatment_lookup(perturbations: DataFrame) -> DataFrame:
    """One row per treatment id, hinted for broadcast only after a size check."""
    return broadcast_if_small(perturbations)


def locus_label(perts: DataFrame) -> DataFrame:
    """(perturbation_id, group): the site of a treatment, or its id when the site is unusable."""
    pid = clean_text(F.col("perturbation_id"))
    chrom = clean_text(F.col("chrom"))
    strand = clean_text(F.col("strand"))
    start, end = as_int(F.col("start")), as_int(F.col("end"))
    usable = (
        (F.coalesce(chrom, F.lit("")) != "")
        & (F.lower(chrom) != "unknown")
        & F.coalesce(start >= 1, F.lit(False))
        & F.coalesce(end >= 1, F.lit(False))
    )
    bare = F.regexp_replace(chrom, "(?i)^chr", "")
    site = F.concat(
        F.lit("chr"), bare, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"),
        F.when(F.coalesce(strand, F.lit("")) == "", F.lit(".")).otherwise(strand),
    )
    return perts.select(
        pid.alias("perturbation_id"),
        F.when(F.coalesce(usable, F.lit(False)), site).otherwise(F.concat(F.lit("perturbation:"), pid)).alias("group"),
    )


def group_by_locus(cells: DataFrame, perturbations: DataFrame) -> DataFrame:
    """(cell_id, group): the site of the cell's treatment."""
    labels = _treatment_lookup(locus_label(perturbations))
    keyed = cells.select("cell_id", clean_text(F.col("perturbation_id")).alias("perturbation_id"))
    return keyed.join(labels, "perturbation_id", "left").select(
        "cell_id",
        F.coalesce("group", F.concat(F.lit("perturbation:"), F.col("perturbation_id"))).alias("group"),
    )


def dose_strength(cells: DataFrame, perturbations: DataFrame) -> DataFrame:
    """(cell_id, strength): dose times knockdown, both cut at 0, missing as 0."""
    doses = _treatment_lookup(
        perturbations.select(
            clean_text(F.col("perturbation_id")).alias("perturbation_id"),
            F.greatest(F.coalesce(as_double(F.col("dose")), F.lit(0.0)), F.lit(0.0)).alias("_dose"),
        )
    )
    knock = F.greatest(F.coalesce(as_double(F.col("knockdown_efficiency_proxy")), F.lit(0.0)), F.lit(0.0))
    keyed = cells.select(
        "cell_id", clean_text(F.col("perturbation_id")).alias("perturbation_id"), knock.alias("_kd")
    )
    return keyed.join(doses, "perturbation_id", "left").select(
        "cell_id", (F.coalesce("_dose", F.lit(0.0)) * F.col("_kd")).alias("strength")
    )


def rank_bins(values: DataFrame, n_bins: int = N_BINS, value: str = "strength") -> DataFrame:
    """(cell_id, group): equal-count bins by stable rank, ties by cell id.

    The rank is global and exact; see :func:`global_rank`. When all values are
    equal up to rounding noise there is a single bin.
    """
    saved = cut_lineage(values.select("cell_id", value), "strength")
    stats = saved.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    n, lo, hi = stats["n"], stats["lo"], stats["hi"]
    if n == 0 or n_bins <= 1 or hi - lo <= 1e-8 + 1e-5 * abs(lo):
        return saved.select("cell_id", F.lit("strength_bin_0").alias("group"))
    ranked = global_rank(saved, [F.col(value), F.col("cell_id")])
    bin_no = F.least(F.floor(F.col("rank") * n_bins / F.lit(n)), F.lit(n_bins - 1))
    return ranked.select("cell_id", F.concat(F.lit("strength_bin_"), bin_no.cast("string")).alias("group"))


def shift_groups(cells: DataFrame, perturbations: DataFrame | None, shift_type: str) -> DataFrame:
    """(cell_id, group) for one of the four shift types."""
    if shift_type in ("cell_type", "protocol"):
        return group_by_column(cells, shift_type)
    if shift_type not in S.SHIFT_TYPES:
        raise ValueError(f"unknown shift type '{shift_type}'")
    if perturbations is None:
        raise ValueError(f"the shift type '{shift_type}' needs perturbation metadata")
    if shift_type == "locus":
        return group_by_locus(cells, perturbations)
    return rank_bins(dose_strength(cells, perturbations))


def group_counts(groups: DataFrame) -> DataFrame:
    """(group, n_cells), per shift type when the labels carry one."""
    keys = ["shift_type", "group"] if "shift_type" in groups.columns else ["group"]
    return groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"))


def assign_groups(
    sizes: DataFrame, shift_type: str | None = None, cfg: SplitSettings | None = None
) -> DataFrame:
    """(shift_type, group, n_cells, part): groups in hash order, cut into train, val, test.

    The order is that of a hash of seed, shift type and group name. ``sizes``
    may hold several shift types in a column of that name; all of them are cut
    in the same pass.
    """
    cfg = cfg or SplitSettings()
    named = sizes if shift_type is None else sizes.withColumn("shift_type", F.lit(shift_type))
    key = F.concat(F.lit(f"{cfg.seed}|"), F.col("shift_type"))
    hashed = named.withColumn("_h", F.sha2(F.concat_ws("~", key, F.col("group")), 256))
    ranked = hash_rank(hashed, "_h", "group", "_r", ["shift_type"])
    counts = named.groupBy("shift_type").agg(F.count(F.lit(1)).cast("double").alias("_g"))
    tagged = ranked.join(F.broadcast(counts), "shift_type")  # one row per shift type
    n_val = F.greatest(F.lit(1.0), F.bround(F.lit(cfg.val_fraction) * F.col("_g")))
    n_test = F.greatest(F.lit(1.0), F.bround(F.lit(cfg.test_fraction) * F.col("_g")))
    # Shrink val first, then test, until one training group is left over.
    over = F.greatest(n_val + n_test - (F.col("_g") - 1), F.lit(0.0))
    val_cut = F.least(over, n_val - 1)
    n_val_final = n_val - val_cut
    n_test_final = n_test - F.least(over - val_cut, n_test - 1)
    first_test = F.col("_g") - n_test_final
    first_val = first_test - n_val_final
    three = (
        F.when(F.col("_r") <= first_val, "train").when(F.col("_r") <= first_test, "val").otherwise("test")
    )
    two = F.when(F.col("_r") == 1, "train").otherwise("test")
    part = F.when(F.col("_g") >= 3, three).when(F.col("_g") == 2, two).otherwise("train")
    return tagged.select("shift_type", "group", "n_cells", part.alias("part"))


def undersized_fallback(assigned: DataFrame, cfg: SplitSettings | None = None) -> DataFrame:
    """(shift_type, group, n_cells, part, fallback, reason) after the rules for too small parts.

    Works on the group table. The decisions need only part totals and the
    second largest group of each shift type, one row per shift type.
    """
    cfg = cfg or SplitSettings()
    low = cfg.min_cells
    saved = cut_lineage(assigned, "groups")

    def total(part: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("part") == part, F.col("n_cells"))), F.lit(0))

    by_size = F.struct(-F.col("n_cells"), F.col("group"))
    facts = saved.groupBy("shift_type").agg(
        F.count(F.lit(1)).alias("_g"),
        total("train").alias("_tr"),
        total("val").alias("_va"),
        total("test").alias("_te"),
        F.min_by("group", by_size).alias("_first"),
    )
    second = (
        saved.join(F.broadcast(facts.select("shift_type", "_first")), "shift_type")
        .where(F.col("group") != F.col("_first"))
        .groupBy("shift_type")
        .agg(F.min_by("group", by_size).alias("_second"))
    )
    small = lambda c: (F.col(c) > 0) & (F.col(c) < low)
    info = facts.join(second, "shift_type", "left").select(
        "shift_type",
        "_g",
        "_second",
        (small("_tr") | small("_va") | small("_te")).alias("_small"),
        small("_te").alias("_small_test"),
    )
    folded = F.when(F.col("_small") & (F.col("part") == "val"), "train").otherwise(F.col("part"))
    swapped = (
        F.when(~(F.col("_small") & F.col("_small_test")), folded)
        .when(F.col("_g") < 2, F.lit("train"))
        .when(F.col("group") == F.col("_second"), "test")
        .otherwise("train")
    )
    moved = saved.join(F.broadcast(info), "shift_type").withColumn("_p", swapped)
    train = moved.groupBy("shift_type").agg(
        F.coalesce(F.sum(F.when(F.col("_p") == "train", F.col("n_cells"))), F.lit(0)).alias("_train")
    )
    done = moved.join(F.broadcast(train), "shift_type").withColumn(
        "_tiny", F.col("_small") & (F.col("_train") < low)
    )
    reason = (
        F.when(F.col("_tiny"), ALL_TRAIN)
        .when(F.col("_small"), SMALL_PART)
        .when(F.col("_g") == 2, TWO_GROUPS)
        .when(F.col("_g") == 1, ONE_GROUP)
    )
    return done.select(
        "shift_type",
        "group",
        "n_cells",
        F.when(F.col("_tiny"), "train").otherwise(F.col("_p")).alias("part"),
        (F.col("_small") | (F.col("_g") <= 2)).alias("fallback"),
        reason.alias("reason"),
    )


def split_cells(labels: DataFrame, parts: DataFrame) -> DataFrame:
    """(cell_id, shift_type, part, group): the part of every cell.

    ``labels`` is (cell_id, shift_type, group).
    """
    lookup = broadcast_if_small(parts.select("shift_type", "group", "part"))
    return labels.join(lookup, ["shift_type", "group"]).select("cell_id", "shift_type", "part", "group")


def _labelled(
    cells: DataFrame, perturbations: DataFrame | None, shift_types: tuple[str, ...]
) -> DataFrame:
    out: DataFrame | None = None
    for kind in shift_types:
        part = shift_groups(cells, perturbations, kind).select(
            "cell_id", F.lit(kind).alias("shift_type"), "group"
        )
        out = part if out is None else out.unionByName(part)
    return out


def _split(labels: DataFrame, cfg: SplitSettings) -> tuple[DataFrame, DataFrame]:
    parts = cut_lineage(undersized_fallback(assign_groups(group_counts(labels), None, cfg), cfg), "parts")
    if parts.isEmpty():
        raise ValueError("no groups to split")
    return split_cells(labels, parts), parts


def split(
    cells: DataFrame, perturbations: DataFrame | None, shift_type: str, cfg: SplitSettings | None = None
) -> tuple[DataFrame, DataFrame]:
    """The assignment of every cell and the group table behind it."""
    return _split(_labelled(cells, perturbations, (shift_type,)), cfg or SplitSettings())


def split_all(
    cells: DataFrame,
    perturbations: DataFrame | None,
    cfg: SplitSettings | None = None,
    shift_types: tuple[str, ...] = S.SHIFT_TYPES,
) -> DataFrame:
    """Assignments of several shift types in one table, from one pass of group sizes."""
    return _split(_labelled(cells, perturbations, shift_types), cfg or SplitSettings())[0]


_PAIRS = (("train", "val"), ("train", "test"), ("val", "test"))


def leakage_report(assignment: DataFrame, cells: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of counts, flags and messages about one split.

    ``assignment`` is (cell_id, part), ``groups`` the independently derived
    (cell_id, group). Overlaps come from per-cell and per-group part sets, so
    no part is joined with another and a huge group costs one row per task.
    """
    known = cells.select("cell_id").distinct().withColumn("_known", F.lit(True))
    has = {p: F.bool_or(F.col("part") == p).alias(p) for p in S.SPLIT_PARTS}
    times = {p: F.count_if(F.col("part") == p).alias(f"n_{p}") for p in S.SPLIT_PARTS}
    per_cell = assignment.groupBy("cell_id").agg(*has.values(), *times.values())
    joined = per_cell.join(known, "cell_id", "full_outer").na.fill(False, ["_known", *S.SPLIT_PARTS])
    saved = cut_lineage(joined.join(groups.select("cell_id", "group"), "cell_id", "left"), "audit")
    aggs: list[Column] = []
    for p in S.SPLIT_PARTS:
        n = F.coalesce(F.col(f"n_{p}"), F.lit(0))
        aggs.append(F.sum(F.greatest(n - 1, F.lit(0))).alias(f"duplicates_{p}"))
        aggs.append(F.sum(F.when(~F.col("_known"), n).otherwise(0)).alias(f"unknown_{p}"))
        aggs.append(F.sum(F.when(F.col("_known"), n).otherwise(0)).alias(f"cells_{p}"))
    for a, b in _PAIRS:
        aggs.append(F.count_if(F.col(a) & F.col(b)).alias(f"cell_overlap_{a}_{b}"))
    any_part = F.col("train") | F.col("val") | F.col("test")
    aggs += [
        F.count_if(F.col("_known")).alias("n_cells"),
        F.count_if(any_part).alias("n_assigned"),
        F.count_if(F.col("_known") & ~any_part).alias("n_missing"),
    ]
    per_group = (
        saved.where(F.col("_known") & F.col("group").isNotNull())
        .groupBy("group")
        .agg(*[F.bool_or(p).alias(p) for p in S.SPLIT_PARTS])
    )
    group_aggs = [F.count_if(p).alias(f"groups_{p}") for p in S.SPLIT_PARTS]
    group_aggs += [F.count_if(F.col(a) & F.col(b)).alias(f"group_overlap_{a}_{b}") for a, b in _PAIRS]
    names = [f"groups_{p}" for p in S.SPLIT_PARTS] + [f"group_overlap_{a}_{b}" for a, b in _PAIRS]
    groups_row = per_group.agg(*group_aggs).select(F.struct(*names).alias("g")).scalar()
    row = saved.agg(*aggs).withColumn("_g", groups_row).select("*", *[F.col(f"_g.{n}") for n in names]).drop("_g")

    messages: list[Column] = []
    for p in S.SPLIT_PARTS:
        messages.append(F.when(F.col(f"duplicates_{p}") > 0, f"duplicate cells in {p}"))
        messages.append(F.when(F.col(f"unknown_{p}") > 0, f"unknown cells in {p}"))
    for a, b in _PAIRS:
        messages.append(F.when(F.col(f"cell_overlap_{a}_{b}") > 0, f"cells shared by {a} and {b}"))
    messages.append(F.when(F.col("n_missing") > 0, "cells without a part"))
    for a, b in _PAIRS:
        messages.append(F.when(F.col(f"group_overlap_{a}_{b}") > 0, f"groups shared by {a} and {b}"))
    leaks = [F.col(f"{kind}_overlap_{a}_{b}") for kind in ("cell", "group") for a, b in _PAIRS]
    total_leaks = leaks[0]
    for extra in leaks[1:]:
        total_leaks = total_leaks + extra
    errors = F.filter(F.array(*messages), lambda m: m.isNotNull())
    return row.withColumn("leakage_detected", total_leaks > 0).withColumn("errors", errors).withColumn(
        "is_valid", F.size("errors") == 0
    )


def fingerprint(cells: DataFrame, groups: DataFrame, n_features: int) -> DataFrame:
    """One row that identifies the data of a split, independent of row order."""
    cols = [c for c in ("perturbation_id", "cell_type", "protocol") if c in cells.columns]
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("cell_id", *cols, "group")]
    rows = cells.select("cell_id", *cols).join(groups.select("cell_id", "group"), "cell_id")
    per_row = F.xxhash64(*text)
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(per_row).alias("x"),
        F.sum(F.pmod(per_row, F.lit(2**31 - 1))).alias("s"),
    ).select(
        F.sha2(F.concat_ws("|", "n", F.lit(n_features), F.concat_ws(",", *[F.lit(c) for c in cols]), "x", "s"), 256).alias(
            "fingerprint"
        )
    )


def split_provenance(
    parts: DataFrame, shift_type: str, cfg: SplitSettings, fingerprint_row: DataFrame, dataset: str | None = None
) -> DataFrame:
    """One row with group sizes, parts, fallback, seeds and versions."""

    def names(part: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("part") == part, F.col("group")))).alias(f"{part}_groups")

    row = parts.where(F.col("shift_type") == shift_type).agg(
        F.count(F.lit(1)).alias("group_count"),
        F.sum("n_cells").alias("n_cells"),
        F.map_from_entries(F.collect_list(F.struct("group", "n_cells"))).alias("group_cell_counts"),
        *[names(p) for p in S.SPLIT_PARTS],
        F.bool_or("fallback").alias("fallback_applied"),
        F.max("reason").alias("fallback_reason"),
    )
    return row.select(
        F.lit(S.SPLIT_VERSION).alias("schema_version"),
        F.lit(S.TABLE_SCHEMA_VERSION).alias("table_schema_version"),
        F.lit(shift_type).alias("shift_type"),
        F.lit(dataset).cast("string").alias("dataset_name"),
        F.lit(cfg.seed).alias("seed"),
        F.lit(cfg.val_fraction).alias("val_fraction"),
        F.lit(cfg.test_fraction).alias("test_fraction"),
        F.lit(cfg.min_cells).alias("min_cells_per_split"),
        "*",
        fingerprint_row.scalar().alias("fingerprint"),
    )
