"""Line deduplication where one host has a third of all pages."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftmill.llm import line_dedup


@pytest.mark.parametrize("bytes_", [0, 32 << 20])
@pytest.mark.parametrize("share", [0.1, 2.0])
def test_a_hot_host_is_cleaned_like_others(spark, monkeypatch, bytes_, share):
    """Hot hosts met by broadcast or none, boilerplate broadcast or shuffled; a null host has no boilerplate."""
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", bytes_)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(240):
        host = "hot" if k % 3 == 0 else None if k % 31 == 1 else f"h{k % 17}"
        lines = [f"l{x}" for x in rng.integers(0, 12, int(rng.integers(0, 8)))] + (["menu"] if rng.random() < 0.5 else [])
        rows.append((k, host, lines, "old"))
    df = spark.createDataFrame(rows, "page_id long, site string, lines array<string>, host string").repartition(5)
    out = {r.page_id: r for r in line_dedup.drop_site_boilerplate(df, F.col("site"), F.col("lines"), 0.3).collect()}
    pages, seen = Counter(h for _, h, _, _ in rows), defaultdict(Counter)
    for _, h, lines, _ in rows:
        seen[h].update(set(lines))
    for k, h, lines, _ in rows:
        kept = [x for x in lines if h is None or seen[h][x] < 2 or seen[h][x] <= 0.3 * pages[h]]
        assert (out[k].host, out[k].n_lines, out[k].n_dropped, out[k].clean_text) == (h, len(lines), len(lines) - len(kept), "\n".join(kept))
