"""Rare bytes after common contexts, and prefixes of conversations."""

import math

import numpy as np
import pytest

from pageloom.llm import chat, ctw


@pytest.mark.parametrize("common", [ord("a"), 0xFE])
def test_rare_bytes_after_a_common_context_have_finite_scores(common):
    """A byte never met after a billion others keeps its probability of one in some billions; it is not lost next to 1."""
    n = 10**9
    model = ctw.train(np.array([(common << 16) | (common << 8) | common]), np.array([n]))
    table = model.table[model.row[(common << 8) | common]].astype(float)
    assert np.isfinite(table).all()
    # The first decision against all that was met: 1/2 of 10**9 + 1; the seven behind it were never met.
    away = common ^ 0x80
    assert table[away] == pytest.approx(math.log10(0.5 / (n + 1)) - 7 * math.log10(2), abs=1e-3)
    # Against it in the last decision only.
    assert table[common ^ 1] == pytest.approx(math.log10(0.5 / (n + 1)), abs=1e-3)


def test_prefixes_of_the_own_template_are_compared(spark, monkeypatch):
    """What the digests are made of sees a template that rewrites history, without being handed one."""
    rows = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    prefixes = []

    def counted(turns):
        prefixes.append(list(turns))
        return f"{len(turns)} turns\n" + "".join(f"{role}: {text}\n" for role, text in turns)

    plain = chat.format_rows(rows)
    assert not plain["rewritten"] and [plain["formatted"][a:b] for a, b in plain["loss"]] == ["b", "d"]
    monkeypatch.setattr(chat, "chat_template", counted)
    got = chat.format_rows(rows)
    assert got["rewritten"] and got["loss"] == []
    assert all(rows[:n] in prefixes for n in range(5))
