"""Parameter search and algorithm benchmarks: driver loops around Spark jobs."""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypergraph_spark.operators.metrics import node_classification_scores
from hypergraph_spark.plans.graph import graph_from_lines
from hypergraph_spark.sources.datasets import load_dataset


def _try(graph, labels, embed_fn, params, eval_fn, metric, seed) -> dict:
    try:
        emb = embed_fn(graph, **params)
        scores = eval_fn(emb, labels) if eval_fn else node_classification_scores(emb, labels, seed=seed)
        return {"params": params, "score": scores[metric], "metrics": scores}
    except Exception as e:  # a failed combination is a result, the search goes on
        return {"params": params, "error": str(e)}


def _best(results: list[dict]) -> dict:
    best = {"best_params": None, "best_score": -1.0, "all_results": results}
    for r in results:
        if r.get("score", -1.0) > best["best_score"]:
            best |= {"best_params": r["params"], "best_score": r["score"]}
    return best


def grid_search(graph, labels: DataFrame, embed_fn: Callable, param_grid: dict, eval_fn: Callable | None = None, metric: str = "accuracy", seed: int = 42) -> dict:
    """All combinations; the first of the best wins."""
    combos = [dict(zip(param_grid, values, strict=True)) for values in itertools.product(*param_grid.values())]
    return _best([_try(graph, labels, embed_fn, p, eval_fn, metric, seed) for p in combos])


def random_search(graph, labels: DataFrame, embed_fn: Callable, distributions: dict, n_iter: int = 20, eval_fn: Callable | None = None, metric: str = "accuracy", seed: int = 42) -> dict:
    """Drawn combinations: a list is a choice, an (int, int) an inclusive range, a (float, float) uniform, all else constant."""
    rng = random.Random(seed)

    def draw(d):
        if isinstance(d, list):
            return rng.choice(d)
        if isinstance(d, tuple) and len(d) == 2:
            return rng.randint(*d) if all(isinstance(x, int) for x in d) else rng.uniform(*d)
        return d

    return _best([_try(graph, labels, embed_fn, {k: draw(d) for k, d in distributions.items()}, eval_fn, metric, seed) for _ in range(n_iter)])


def benchmark_algorithms(graph, labels: DataFrame, algorithms: dict[str, Callable], num_runs: int = 1, seed: int = 42) -> dict:
    """{name: seconds and mean scores}; a failure is kept as error."""
    out = {}
    for name, fn in algorithms.items():
        runs = []
        try:
            for _ in range(num_runs):
                began = time.time()
                emb = fn(graph).cache()
                emb.count()
                runs.append({"seconds": time.time() - began} | node_classification_scores(emb, labels, seed=seed))
                emb.unpersist()
            out[name] = {k: sum(r[k] for r in runs) / len(runs) for k in runs[0]}
        except Exception as e:
            out[name] = {"error": str(e)}
    return out


def benchmark_datasets(spark: SparkSession, datasets: list[str], embed_fn: Callable, num_runs: int = 1, seed: int = 42, paths: dict[str, str] | None = None) -> dict:
    """{dataset: entities, edges, seconds and mean scores of embed_fn(graph)}; a failure is kept as error."""
    out = {}
    for name in datasets:
        try:
            data = load_dataset(spark, name, (paths or {}).get(name))
            graph = graph_from_lines(data["edges"].select(F.concat_ws(" ", "src", "dst").alias("value")), data["columns"]).cache()
            sizes = {"entities": graph.num_entities(), "edges": graph.num_edges()}
            out[name] = sizes | benchmark_algorithms(graph, data["labels"], {name: embed_fn}, num_runs, seed)[name]
        except Exception as e:
            out[name] = {"error": str(e)}
    return out


def format_dataset_table(results: dict, metric: str = "accuracy") -> str:
    lines = [f"{'dataset':<20} {'entities':>10} {'edges':>12} {metric:>10} {'seconds':>10}"]
    for name, r in results.items():
        lines.append(f"{name:<20} " + ("error: " + r["error"] if "error" in r else f"{r['entities']:>10} {r['edges']:>12} {r[metric]:>10.4f} {r['seconds']:>10.2f}"))
    return "\n".join(lines)


def format_table(results: dict, metric: str = "accuracy") -> str:
    lines = [f"{'name':<20} {metric:>10} {'seconds':>10}"]
    for name, r in results.items():
        lines.append(f"{name:<20} {'error: ' + r['error'] if 'error' in r else f'{r[metric]:>10.4f} {r['seconds']:>10.2f}'}")
    return "\n".join(lines)
