"""The classifier measures texts in small blocks; what it finds of a text does not depend on them."""

import numpy as np
import pyarrow as pa

from colloquy.llm import quality_classifier as q


def test_scores_are_the_same_whatever_the_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    column = pa.array([" ".join("".join(rng.choice(list("abcdefg"), rng.integers(1, 9))) for _ in range(rng.integers(0, 200))) for _ in range(120)])
    model = q.FittedQuality(q.QualityModel(), q.Stems(), rng.normal(size=(1 << 18) + 1).astype(np.float32), {})
    scores = []
    for block in (1 << 10, 1 << 14, 1 << 21):
        monkeypatch.setattr(q, "BLOCK", block)
        scores.append(np.concatenate([score for _, _, score, _ in q._scores(model, column)]))
    assert all((s == scores[0]).all() for s in scores)


def test_blocks_are_small():
    assert sum(1 for _ in q.tk.blocks(pa.array(["word " * 2000] * 200), q.BLOCK)) >= 7  # 2 MB; once one block
