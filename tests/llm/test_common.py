from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import cluster
from tessera.llm import common as C

from llm_samples import WORD

texts = st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab é\n\t日"), max_size=12)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words(values):
    data, off = C.strings(pa.array(values, pa.string()))
    starts, ends, woff = C.words(data, off)
    raw = data.tobytes()
    got = [[raw[starts[k] : ends[k]].decode() for k in range(woff[i], woff[i + 1])] for i in range(len(values))]
    assert got == [WORD.findall(v or "") for v in values]
    flat = [w for x in got for w in x]
    for h in (None, np.zeros(len(flat), np.uint64)):  # also if all hashes collide
        number, first = C.numbered(data, starts, ends, h)
        assert len(first) == len(set(flat)) and all((number[i] == number[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))
        assert all(number[i] == k for k, i in enumerate(first.tolist()))
    d, s, e, w = C.tidy(data, off)
    assert d.tobytes().decode() == "".join(x + " " for x in flat) and w.tolist() == woff.tolist() and [d[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)] == flat


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab"), max_size=90), min_size=1, max_size=30), st.integers(1, 7))
def test_spans_and_runs(values, k):
    data = np.frombuffer("".join(values).encode(), np.uint8)
    ends = np.cumsum([len(v) for v in values])
    starts = ends - [len(v) for v in values]
    h = C.span_hashes(data, starts, ends)
    assert len(set(h.tolist())) == len(set(values))
    other = np.arange(len(values))[::-1]
    assert C.equal_spans(data, starts, ends, starts[other], ends[other]).tolist() == [a == b for a, b in zip(values, values[::-1], strict=True)]
    runs = C.rolling(h, k).tolist()
    exact = [tuple(values[i : i + k]) for i in range(len(values) - k + 1)]
    assert len(runs) == len(exact) and len(set(runs)) == len(set(exact))


def test_slices_and_kinds():
    a = pa.array(["xx", None, "abc", ""]).slice(1, 3)
    data, off = C.strings(a)
    assert data.tobytes() == b"abc" and off.tolist() == [0, 0, 3, 3]
    assert C.strings(pa.chunked_array([], pa.string()))[1].tolist() == [0]
    assert C.strings(pa.array([b"a", None], pa.large_binary()))[1].tolist() == [0, 1, 1]
    assert C.ragged(np.array([5, 1]), np.array([2, 3])).tolist() == [5, 6, 1, 2, 3]
    assert C.cover(np.array([1, 2]), 2, 6).tolist() == [False, True, True, True, False, False]
    assert list(C.blocks(np.array([0, 5, 5, 20, 21]), 6)) == [(0, 2), (2, 3), (3, 4)]


def test_shared_folder(spark, monkeypatch):
    """Tables are listed by the run that wrote them; without a shared folder a cluster is an error."""
    df = spark.range(5)
    with cluster.scratch() as mine:
        cluster.stored(df)
        with cluster.scratch() as other:
            kept = cluster.stored(df)
        assert len(mine) == len(other) == 1 and mine != other
        cluster.release(spark, mine)
        assert mine == [] and kept.count() == 5
    assert cluster.stored(df).count() == 5 and mine == []

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf = {}
        sparkContext = Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        cluster.shared_dir(Session)
