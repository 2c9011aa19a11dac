import numpy as np

from pathloom.llm import near_dups


def drawn(rng, n):
    return np.sort(rng.integers(0, 1 << 64, n, np.uint64))


def test_unlike_sets_dont_meet_under_their_signatures():
    rng = np.random.default_rng(0)
    signed = np.array([near_dups.signature(drawn(rng, 20_000)) for _ in range(400)])
    assert all(len(np.unique(column)) == len(signed) for column in signed.T)


def test_signatures_agree_as_often_as_sets_overlap():
    rng, share = np.random.default_rng(1), 0.85
    agreed = []
    for _ in range(400):
        core, rest = drawn(rng, 1700), [drawn(rng, 150) for _ in "ab"]
        a, b = (near_dups.signature(np.sort(np.concatenate([core, r]))) for r in rest)
        agreed.append((a == b).sum())
    assert abs(np.mean(agreed) / near_dups.COORDINATES - share) < 0.01
    assert abs(np.var(agreed) / (near_dups.COORDINATES * share * (1 - share)) - 1) < 0.3 and min(agreed) >= near_dups.matches((85, 100))


def test_sets_of_a_slice_are_those_of_each_text():
    import pyarrow as pa

    texts = ["a b c a b c", None, "x", "", "b a", "c c c c c", "b c a b"]
    for w in near_dups.tk.words(pa.array(texts), lower=True):
        got = list(near_dups._sets_of(w, 3))
        want = [near_dups.shingle_set(w.hashes[i:j], 3) for i, j in zip(w.bounds[:-1], w.bounds[1:])]
        assert [g.tolist() for g in got] == [x.tolist() for x in want] and [len(g) for g in got] == [3, 0, 1, 0, 1, 1, 2]
