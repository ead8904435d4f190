"""Merkle manifest against a plain construction of the trees, and the scheduling of its stacks; its SQL is tried in test_oracles.py."""

import hashlib
import zlib

import pytest
from tremor.llm import merkle as M


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows):
    """doc_id, leaf, subroot, root, proof, folded, verified of (doc_id, text, lang, source, n_chars) by whole levels in memory."""

    def leaf(doc_id, text, lang, source, n_chars):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])

    def climb(nodes):
        levels = [nodes]
        while len(nodes) > 1:
            nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
            levels.append(nodes)
        return levels

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            out.append((run[: i % 8], run[i % 8 + 1 :]))
            i //= 8
        return out

    trees = {}
    for lang in sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(((r, leaf(*r)) for r in rows if r[2] == lang), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[lang] = own, climb([x for _, x in own])
    over = climb([levels[-1][0] for _, levels in trees.values()])
    for k, (own, levels) in enumerate(trees.values()):
        for i, (r, x) in enumerate(own):
            whole = path(levels, i) + path(over, k)
            text = r[1]
            if text is not None and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(r[0], text, *r[2:])
            for a, b in whole:
                node = H(*a, node, *b)
            yield r[0], x, levels[-1][0], over[-1][0], H(*[s for a, b in whole for s in (*a, *b)]), node, node == over[-1][0]


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_rows():
    rows = [(i, f"Text {i} É", "en", "web", i) for i in range(1100)]
    rows += [(i, "UPPER" if i % 2 else "", "ß" if i % 3 else None, None, None) for i in range(30)]
    rows += [(7, "Twice", "fr", "x", 1)] * 9 + [(None, None, None, None, None)] * 2 + [(None, "A" * 100_000, "de", "x", 5)]
    return rows


def test_audit_against_plain_trees(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], COLUMNS + ", leaf string, grp string, place int")
    got = sorted(map(tuple, M.audit(M.manifest(docs, M.tampered())).collect()), key=repr)
    assert got == sorted(plain(rows), key=repr)
    assert M.audit(M.manifest(docs.where("false"))).count() == 0


def test_one_row_is_its_own_root(spark):
    rows = [(5, "Abc", "en", "web", 3)]
    (got,) = M.audit(M.manifest(spark.createDataFrame(rows, COLUMNS))).collect()
    assert got.leaf == got.subroot == got.root == got.folded_root and got.verified
    assert got.proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_proofs_are_enough_for_a_verifier(spark):
    rows = [(i, f"t{i}", "en", "web", 2) for i in range(600)] + [(i, "t", "de", "web", 1) for i in range(3)]
    found = M.proofs(M.manifest(spark.createDataFrame(rows, COLUMNS))).collect()
    assert len({r.root for r in found}) == 1 and len(found) == 603
    for r in found:
        assert M.fold(r.leaf, [(s.place, s.siblings) for s in r.path]) == r.root
    wrong = next(r for r in found if r.doc_id == 300)
    assert M.fold(found[0].leaf, [(s.place, s.siblings) for s in wrong.path]) != wrong.root


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 511, 512])
def test_stacks_are_ready_in_time_and_stay_small(n, monkeypatch):
    late, most = [], 0
    finish = M.Treehash.finish

    def watched(self, leaves):
        if 0 < self.at < self.stop:  # the first runs begin at 0, all others should be ready
            late.append((self.height, self.at, self.stop))
        return finish(self, leaves)

    monkeypatch.setattr(M.Treehash, "finish", watched)
    leaves = [H(str(i)) for i in range(n)]
    height = M.block_height(0, n)
    top = M.top(leaves, height)
    step = M.Treehash.step

    def counted(self, leaves):
        nonlocal most
        step(self, leaves)
        most = max(most, len(self.stack))

    monkeypatch.setattr(M.Treehash, "step", counted)
    for i, path in enumerate(M.traverse(leaves, height)):
        node = leaves[i]
        for place, run in path:
            assert run[place] == node
            node = H(*run)
        assert node == top
    assert not late and most <= (M.FAN - 1) * M.LEVELS
