"""Whole-tree analysis: functions, graph, roots and call paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..extract.udtf import functions_of
from ..operators.graph import build_graph, roots, simple_paths
from ..session import Stages


@dataclass
class Analysis:
    nodes: DataFrame
    edges: DataFrame
    references: DataFrame
    roots: DataFrame
    paths: DataFrame


def analyze(files: DataFrame, include_tests: bool = True) -> Analysis:
    """Analyse ``files`` (path, content): nodes, edges, references, roots and the paths from them."""
    stages = Stages(files.sparkSession, "analyze")
    nodes, edges, refs = (stages.put(t) for t in build_graph(functions_of(files, include_tests)))
    return Analysis(nodes, edges, refs, roots(nodes, edges), simple_paths(nodes, edges))
