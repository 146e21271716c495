"""Topic clusters of a document's sentence vectors: average linkage on cosine distance, then nine se_ features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CLUSTER_T = 0.52
#: Sentences of a document up to which all distances are held at once.
DENSE = 2_000
FEATURES = ["se_n_clusters", "se_cluster_entropy", "se_dominant_cluster_frac", "se_switch_count", "se_switch_rate", "se_switch_weighted", "se_switch_mean_jump", "se_intra_mean", "se_inter_mean"]


def average_linkage(x: np.ndarray, threshold: float = CLUSTER_T) -> np.ndarray:
    """Labels by first member. The pair of least mean distance merges, first on ties, until it is above the threshold.

    Sums of distances between clusters are kept and added on a merge, and each row keeps its least mean distance to a later
    one, so a merge costs a few rows: the square of a document's sentences in most cases.
    """
    n = len(x)
    if not n:
        return np.zeros(0, np.int64)
    total = 1.0 - x @ x.T
    size = np.ones(n)
    label = np.arange(n)
    mean = np.where(np.triu(np.ones((n, n), bool), 1), total, np.inf)
    least, to = mean.min(1, initial=np.inf), mean.argmin(1)
    alive = np.ones(n, bool)
    for _ in range(n - 1):
        a = int(least.argmin())
        if not least[a] <= threshold:
            break
        b = int(to[a])
        total[a] += total[b]
        total[:, a] += total[:, b]
        size[a] += size[b]
        alive[b] = False
        label[label == b] = a
        mean[b], mean[:, b], least[b] = np.inf, np.inf, np.inf
        ids = np.flatnonzero(alive)
        others = ids[ids != a]
        new = total[a, others] / (size[a] * size[others])
        before, after = others < a, others > a
        mean[a, others[after]] = new[after]
        rows, new = others[before], new[before]
        mean[rows, a] = new
        closer = (new < least[rows]) | ((new == least[rows]) & (a < to[rows]))
        stale = ids[(to[ids] == b) | ((to[ids] == a) & (ids < a))]
        least[rows[closer]], to[rows[closer]] = new[closer], a
        again = np.append(stale, a)
        least[again], to[again] = mean[again].min(1), mean[again].argmin(1)
    return np.unique(label, return_inverse=True)[1]


def linkage_by_sums(x: np.ndarray, threshold: float = CLUSTER_T) -> np.ndarray:
    """average_linkage() of many unit vectors without their distances: memory is that of the vectors.

    The mean distance of two clusters is 1 less the product of their sums over their sizes. Chains of nearest neighbours end in
    pairs that are each other's nearest; as a merge brings nothing closer, these merge in any order to the same clusters. A
    cluster whose nearest is beyond the threshold is done.
    """
    sums, size, first = x.copy(), np.ones(len(x)), np.arange(len(x))
    parent, alive, left = np.arange(len(x)), np.ones(len(x), bool), len(x)
    chain: list[int] = []
    start = 0
    while left:
        if 2 * left < len(alive) > 64:
            own = np.flatnonzero(alive)
            place = np.full(len(alive), -1)
            place[own] = np.arange(left)
            chain, start = [int(place[c]) for c in chain], 0
            sums, size, first, alive = sums[own], size[own], first[own], np.ones(left, bool)
        if not chain:
            while not alive[start]:
                start += 1
            chain.append(start)
        a = chain[-1]
        far = 1.0 - (sums @ sums[a]) / (size * size[a])
        far[a] = np.inf
        far[~alive] = np.inf
        b = int(far.argmin())
        if not far[b] <= threshold and (len(chain) == 1 or not far[chain[-2]] <= threshold):
            alive[chain.pop()] = False
            left -= 1
        elif len(chain) > 1 and (b in chain or far[chain[-2]] <= far[b]):
            a, b = sorted((a, chain[-2]), key=lambda c: first[c])
            del chain[-2:]
            sums[a] += sums[b]
            size[a] += size[b]
            parent[first[b]] = first[a]
            alive[b] = False
            left -= 1
        else:
            chain.append(b)
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return np.unique(parent, return_inverse=True)[1]


def cluster_features(x: np.ndarray) -> list[float]:
    n = len(x)
    if n <= 1:
        return [0.0] * len(FEATURES)
    label = average_linkage(x) if n <= DENSE else linkage_by_sums(x)
    count = np.bincount(label)
    k, p = len(count), count / n
    s = (x[:-1] * x[1:]).sum(1)
    switch = label[1:] != label[:-1]
    jump = (1 - s)[switch]
    sums = np.zeros((k, x.shape[1]))
    np.add.at(sums, label, x)
    norm = np.linalg.norm(sums, axis=1)
    many = count > 1
    intra = (p[many] * (norm[many] ** 2 - count[many]) / (count[many] * (count[many] - 1))).sum()
    center = sums / np.maximum(norm, 1e-12)[:, None]
    total = center.sum(0)
    inter = float((total @ total - (center * center).sum()) / (k * (k - 1))) if k > 1 else 1.0
    return [k, float(-(p * np.log(p)).sum() / np.log(k)) if k > 1 else 0.0, p.max(), switch.sum(), switch.mean(), jump.sum() / (n - 1), float(jump.mean()) if len(jump) else 0.0, float(intra), inter]


def topic_clusters(sentences: DataFrame) -> DataFrame:
    """One group is one document: its size is that of the text, not of the corpus. A task holds a document's vectors, and of
    at most DENSE sentences their distances; time goes with the square of a document's sentences."""
    kind = sentences.schema["doc_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("sent_id")
        x = pc.list_flatten(table.column("embedding").combine_chunks()).to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
        found = [float(v) for v in cluster_features(x)]
        return pa.table([table.column("doc_id").slice(0, 1), *[pa.array([v]) for v in found]], names=["doc_id", *FEATURES])

    return sentences.select("doc_id", "sent_id", "embedding").groupBy("doc_id").applyInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} double" for c in FEATURES))
