"""The staged job: ingest, preprocess, embed, train, causal, evaluate, card.

Every stage writes its tables and then one manifest row. A resumed run reads
the manifest, skips what is complete and goes on from the written tables.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treatlens import schema as S
from treatlens.operators import baselines, embeddings, graph, ivgraph, qc, transport, validation
from treatlens.operators.layout import to_sparse
from treatlens.plans.evaluate import EvaluationSettings, evaluate
from treatlens.sources import stages as IO

# Outputs that a complete run must have.
REQUIRED_OUTPUTS = (
    "ingest_cells",
    "preprocess_cells",
    "embed_vectors",
    "transport_model",
    "transport_fit_summary",
    "baseline_suite",
    "graph_edges",
    "graph_edges_csv",
    "graph_metadata",
    "evaluation_report",
    "predictions",
    "card",
)

_MANIFEST = "run_id string, stage string, outputs array<struct<name:string,path:string>>"


@dataclass(frozen=True)
class ChainSettings:
    """Settings of the whole chain."""

    qc: qc.QcSettings = field(default_factory=lambda: qc.QcSettings(min_counts=1, min_genes=1, min_cells=1))
    graph: ivgraph.GraphSettings = field(default_factory=lambda: ivgraph.GraphSettings(draws=0))
    evaluation: EvaluationSettings = field(default_factory=EvaluationSettings)
    embedding_dim: int = 256
    alpha: float = 1e-3
    seed: int = 42
    use_cell_state: bool = True


class Chain:
    """One run below a folder; a stage sees only what earlier stages wrote."""

    def __init__(self, spark: SparkSession, root: str, run_id: str, cfg: ChainSettings) -> None:
        self.spark, self.root, self.run_id, self.cfg = spark, root, run_id, cfg
        self.outputs: dict[str, str] = {}

    def save(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        IO.write_stage(df, path)
        self.outputs[name] = path
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return IO.read_stage(self.spark, f"{self.root}/{name}")

    def feature_ids(self) -> list[str]:
        return [r["gene_id"] for r in self.read("features").orderBy("idx").collect()]

    def ingest(self, tables: Mapping[str, DataFrame | str | None]) -> None:
        repaired, _ = validation.validate(tables, "repair")
        saved: dict[str, DataFrame | str | None] = {"version": repaired["version"]}
        for name in ("cells", "genes", "expr", "perturbations", "vectors"):
            saved[name] = self.save(f"ingest_{name}", repaired[name])
        _, report = validation.validate(saved, "strict")
        validation.require_valid(report)

    def preprocess(self) -> None:
        done = qc.preprocess(self.read("ingest_cells"), self.read("ingest_expr"), self.cfg.qc)
        self.save("preprocess_cells", done.cells)
        self.save("preprocess_expr", done.expr)
        self.save("features", done.features.select("gene_id", "variance", (F.col("rank") - 1).alias("idx")))
        self.save("preprocess_summary", done.summary)

    def embed(self) -> None:
        cells, dim = self.read("preprocess_cells"), self.cfg.embedding_dim
        provider = embeddings.KmerSpectrum(dim, self.cfg.seed)
        sequences, source = embeddings.sequence_source(cells, perturbations=self.read("ingest_perturbations"))
        vectors = self.save("treatment_vectors", embeddings.treatment_vectors(cells, sequences, provider))
        self.save("sequence_metadata", embeddings.sequence_metadata(cells, vectors, provider, source))
        sparse = self.save(
            "sparse", to_sparse(self.read("preprocess_expr"), self.read("features"), "z", cells.select("cell_id"))
        )
        states = embeddings.embed_cells(
            sparse, len(self.feature_ids()), embeddings.SignProjection(dim, self.cfg.seed)
        )
        # Vectors compress to small files: by their size the planner would broadcast those of all cells.
        both = embeddings.embed_sequences(cells, vectors).join(states.hint("merge"), "cell_id")
        saved = self.save("embed_vectors", both)
        for col in ("sequence_embedding", "cell_state_embedding"):
            validation.require_valid(validation.check_embeddings(saved, cells, col, dim))

    def _pairs(self) -> tuple[DataFrame, list[float] | None, int]:
        cells, vectors = self.read("preprocess_cells"), self.read("embed_vectors")
        n = len(self.feature_ids())
        state = vectors.select("cell_id", "cell_state_embedding") if self.cfg.use_cell_state else None
        rows, source = transport.transport_pairs(
            self.read("sparse"), cells, n, "control_mean", vectors.select("cell_id", "sequence_embedding"), state
        )
        return rows, source, self.cfg.embedding_dim * (2 if self.cfg.use_cell_state else 1)

    def train(self) -> None:
        cells, expr, features = self.read("preprocess_cells"), self.read("preprocess_expr"), self.read("features")
        base = graph.correlation_graph(expr, cells, features.select("gene_id", "idx"))
        base = self.save("reference_graph", base)
        rewired = self.save("random_graph", graph.rewire(base, self.cfg.seed))
        suite = baselines.baseline_suite(
            expr, cells, expr, cells, features.select("gene_id"), graph.graph_metrics(base, rewired)
        )
        suite = self.save("baseline_suite", suite)
        missing = [r[0] for r in baselines.require_baselines(suite, S.BASELINE_NAMES).collect()]
        if missing:
            raise ValueError(f"training needs the baselines {', '.join(sorted(missing))}")
        rows, source, n_w = self._pairs()
        rows = self.save("training_rows", rows)
        ids = self.feature_ids()
        transport.check_pairs(rows, n_w, len(ids))
        model = transport.fit_linear_transport(rows, source, n_w, len(ids), self.cfg.alpha)
        self.save("transport_model", transport.model_rows(model, rows, ids))
        self.save("model_moments", transport.model_moments(rows, model, features.select("gene_id", "idx")))
        self.save("transport_fit_summary", transport.model_nll(self.read("model_moments")))

    def causal(self) -> None:
        cells, expr = self.read("preprocess_cells"), self.read("preprocess_expr")
        fit = ivgraph.iv_graph(cells, expr, self.read("ingest_genes"), self.cfg.graph)
        edges = self.save("graph_edges", fit.edges)
        meta = fit.diagnostics.select(
            "*",
            fit.proxy_names.agg(
                F.transform(F.sort_array(F.collect_list(F.struct("i", "name"))), lambda x: x["name"])
            ).scalar().alias("proxy_design_columns"),
            F.lit(fit.reference).alias("instrument_reference"),
            F.lit(self.cfg.graph.draws).alias("bootstrap_iterations"),
            F.lit(self.cfg.graph.level).alias("confidence_level"),
            F.lit(True).alias("cyclic_allowed"),
        )
        IO.write_edges(edges, f"{self.root}/causal", meta)
        self.outputs["graph_edges_csv"] = f"{self.root}/causal/edges"
        self.outputs["graph_metadata"] = f"{self.root}/causal/metadata"

    def evaluate(self) -> None:
        model = transport.load_model(self.read("transport_model"))
        self.save("predictions", transport.predict_distribution(self.read("training_rows"), model))
        moments = self.read("model_moments")
        control = self.read("transport_model").select("gene_id", F.col("source").alias("control_mean"))
        done = evaluate(
            moments, transport.model_calibration_rows(moments), control, self.read("baseline_suite"), self.cfg.evaluation
        )
        self.save("evaluation_report", done.report)

    def card(self) -> None:
        path = f"{self.root}/card"
        IO.write_report(self.read("evaluation_report"), path)
        self.outputs["card"] = path


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Manifest rows of a run folder, one per finished stage."""
    return spark.read.schema(_MANIFEST).json(f"{root}/manifest/*")


def missing_outputs(spark: SparkSession, root: str) -> DataFrame:
    """Required outputs that no manifest row lists."""
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in REQUIRED_OUTPUTS])).alias("name"))
    listed = read_manifest(spark, root).select(F.explode("outputs.name").alias("name"))
    return wanted.join(listed, "name", "left_anti")


def run_stages(
    spark: SparkSession,
    tables: Mapping[str, DataFrame | str | None],
    root: str,
    run_id: str,
    cfg: ChainSettings | None = None,
    stop_after: str | None = None,
    resume: bool = False,
) -> DataFrame:
    """Run the chain below ``root``; returns (stage, skipped) rows of this call.

    With ``resume`` the stages already in the manifest are skipped; the run id
    must be the one they were written under.
    """
    if stop_after is not None and stop_after not in S.STAGES:
        raise ValueError(f"unknown stage '{stop_after}'")
    done: set[str] = set()
    if resume:
        try:
            rows = read_manifest(spark, root).select("run_id", "stage").collect()
        except AnalysisException as error:
            raise ValueError(f"nothing to resume at {root}") from error
        if any(r["run_id"] != run_id for r in rows):
            raise ValueError(f"the run at {root} has another id than '{run_id}'")
        done = {r["stage"] for r in rows}
    chain = Chain(spark, root, run_id, cfg or ChainSettings())
    log: list[tuple[str, bool]] = []
    for stage in S.STAGES:
        if stage in done:
            log.append((stage, True))
        else:
            chain.outputs = {}
            step = getattr(chain, stage)
            step(tables) if stage == "ingest" else step()
            entry = F.array(
                *[F.struct(F.lit(k).alias("name"), F.lit(v).alias("path")) for k, v in chain.outputs.items()]
            )
            spark.range(1).select(
                F.lit(run_id).alias("run_id"), F.lit(stage).alias("stage"), entry.alias("outputs")
            ).write.mode("overwrite").json(f"{root}/manifest/{stage}")
            log.append((stage, False))
        if stage == stop_after:
            break
    if stop_after is None or stop_after == S.STAGES[-1]:
        missing = sorted(r["name"] for r in missing_outputs(spark, root).collect())
        if missing:
            raise ValueError(f"the run is incomplete, missing: {', '.join(missing)}")
    return spark.createDataFrame(log, "stage string, skipped boolean")
