import os
import sys

import numpy as np
import pandas as pd
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from treatlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def toy(spark):
    """90 cells, 12 genes, 4 treatments with very uneven sizes; dense truth next to the tables."""
    rng = np.random.default_rng(3)
    n, g = 90, 12
    pert = np.array(["ntc"] * 40 + ["tp53_g1"] * 35 + ["myc_g2"] * 12 + ["rare_g3"] * 3)
    counts = rng.poisson(2.0, (n, g)) * (rng.random((n, g)) < 0.6)
    counts[:, 5] = 0
    counts[pert == "tp53_g1", 2] += 4
    ids = [f"c{i:03d}" for i in range(n)]
    genes = [f"g{j:02d}" for j in range(g)]
    cells = pd.DataFrame(
        {
            "cell_id": ids,
            "cell_type": np.where(np.arange(n) % 3 == 0, "k562", "rpe1"),
            "batch": np.array(["b0", "b1", "b2"])[np.arange(n) % 3],
            "condition": np.where(pert == "ntc", "control", "perturbed"),
            "protocol": np.where(np.arange(n) % 2 == 0, "p0", "p1"),
            "library_size": counts.sum(1).astype(float),
            "perturbation_id": pert,
            "knockdown_efficiency_proxy": np.where(pert == "ntc", 0.0, rng.random(n)),
        }
    )
    i, j = np.nonzero(counts)
    lib = np.maximum(counts.sum(1), 1)
    z = np.log1p(counts / lib[:, None] * 1e4)
    expr = pd.DataFrame(
        {"cell_id": np.array(ids)[i], "gene_id": np.array(genes)[j], "count": counts[i, j], "z": z[i, j]}
    )
    return {
        "cells": spark.createDataFrame(cells).cache(),
        "expr": spark.createDataFrame(expr).cache(),
        "genes": spark.createDataFrame(pd.DataFrame({"gene_id": genes})).cache(),
        "pdf": cells,
        "counts": counts,
        "z": z,
        "gene_ids": genes,
        "ids": ids,
    }
