"""Queries of the hits with the vectors of `embeddings`, and earlier names of queries that read their whole tables."""

from __future__ import annotations

from ..operators import distances
from ..sources import readers
from . import ingest, statistics
from . import surrogates as S

QUERIES: dict = {
    "embedding_distance_whole": lambda s, d: distances.pair_distances(S.seq_hits(s, d).select("query", "target"), S.vector_stores(s, d), S.HIT_NAMES),
    "store_info_whole": lambda s, d: readers.store_info(S.vector_stores(s, d)),
}
SQL: dict[str, str] = {
    "embedding_distance_whole": f"WITH {S.HIT_DIST} SELECT query, target, embedding_name, distance FROM dist",
    "store_info_whole": f"WITH {S.HIT_STORES} SELECT embedding_name, count(*) AS n_vectors, CAST(max(len(embedding)) AS INT) AS dim, max(len(embedding)) = min(len(embedding)) AS uniform FROM stores GROUP BY 1",
}
for _name in ("hfsp_score", "minmax_normalize", "all_pair_distances", "keep_ids"):
    _part = ingest if _name in ingest.QUERIES else statistics
    QUERIES[f"{_name}_whole"], SQL[f"{_name}_whole"] = _part.QUERIES[_name], _part.SQL[_name]
