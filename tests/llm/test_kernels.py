import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from borespark.llm.kernels import Texts, base_statistics, gram_buckets, slices
from borespark.llm.sketch import prob_jaccard, prob_minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.lists(st.text(alphabet="ab#é \n\t|.", max_size=40) | st.none(), max_size=8)


@given(texts)
@settings(max_examples=150, deadline=None)
def test_words_and_shingles_match_brute_force(values):
    t = Texts(pa.array(values, pa.string()))
    words = [WORD.findall(v or "") for v in values]
    assert t.n_words.tolist() == [len(w) for w in words]
    seen = {}
    for h, w in zip(t.words().tolist(), [w for ws in words for w in ws], strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    element, doc = t.shingles(5)
    want = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in words]
    assert [len(set(element[doc == i].tolist())) for i in range(len(values))] == [len(s) for s in want]


@given(texts)
@settings(max_examples=150, deadline=None)
def test_base_statistics_match_brute_force(values):
    got = base_statistics(Texts(pa.array(values, pa.string())))
    for i, v in enumerate(values):
        v = v or ""
        w = WORD.findall(v)
        count = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeated = {j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in v.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in v), len(lines) - len(set(lines)), len(repeated))
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_long_words_and_slices():
    big = "x" * 400_000
    t = Texts(pa.array([big + " y", "y " + big, big]))
    h = t.words()
    assert h[0] == h[3] == h[4] and h[1] == h[2]
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "c"])], ["text"])
    assert [p.num_rows for p in slices(batch, limit=20)] == [2, 1, 1]
    assert list(slices(batch.slice(0, 0))) == []


@given(st.lists(st.text(alphabet="abé", max_size=6), max_size=6), st.sampled_from([2, 3, 4]))
@settings(max_examples=100, deadline=None)
def test_windows_stay_inside_texts(values, n):
    bucket, bounds = gram_buckets(Texts(pa.array(values, pa.string())), n, 12)
    assert np.diff(bounds).tolist() == [max(len(v.encode()) - n + 1, 0) for v in values]
    for i, v in enumerate(values):
        alone, _ = gram_buckets(Texts(pa.array([v])), n, 12)
        assert alone.tolist() == bucket[bounds[i] : bounds[i + 1]].tolist()


def test_prob_minhash_estimates_probability_jaccard():
    r = np.random.default_rng(0)
    for _ in range(4):
        a = {int(k): float(w) for k, w in zip(r.integers(0, 1 << 60, 60), 1 + r.random(60) * 3, strict=True)}
        b = {k: w * float(r.random() + 0.5) for k, w in list(a.items())[:45]} | {int(k): 1.5 for k in r.integers(0, 1 << 60, 10)}
        doc = np.array([0] * len(a) + [1] * len(b))
        m = prob_minhash(doc, np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), 2, 4096)
        assert abs((m[0] == m[1]).mean() - prob_jaccard(a, b)) < 0.04
