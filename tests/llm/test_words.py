import numpy as np

from clickfeat.llm.mixing_lm import FIRST, GROUP, Code
from clickfeat.llm.words import Lookup, U


def test_lookup_finds_what_is_there():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 20_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(U) * U(2))
        asked = np.concatenate((keys, keys + U(1), np.array([0, 2**64 - 1], U)))
        want = np.where(np.isin(asked, keys), np.searchsorted(keys, asked), -1)
        assert (Lookup(keys).find(asked) == want).all()


def test_lookup_of_clustered_keys():
    keys = np.arange(100, 400, dtype=U)
    assert (Lookup(keys).find(np.arange(500, dtype=U)) == np.where((np.arange(500) >= 100) & (np.arange(500) < 400), np.arange(500) - 100, -1)).all()


def test_paths_in_groups():
    """Each decision's place names its node: within one group, equal places stand for equal nodes and others for others."""
    code = Code(np.arange(300, dtype=U), list(range(1, 301)), 5, 9, [i % 7 for i in range(256)])
    assert (code.steps[code.offsets[:-1]] >= FIRST).all()
    node_of, place_of = {}, {}
    for s in range(len(code.offsets) - 1):
        path = range(code.offsets[s], code.offsets[s + 1])
        groups = code.group_nodes[code.group_offsets[s] : code.group_offsets[s + 1]]
        assert len(groups) == -(-len(path) // GROUP)
        for d, at in enumerate(path):
            kind, node = s >= code.first_byte, int(code.nodes[at])
            key = kind, int(groups[d // GROUP]), int(code.steps[at] >> 1) & (2**GROUP - 1)
            assert node_of.setdefault(key, node) == node
            assert place_of.setdefault((kind, node), key) == key
