"""Rows for the tests of the training-data operators."""

import random


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, copies, repeated rows, shared passages, special strings."""
    passage = prose(7, 60)
    texts = ["", None, " \t\n", "one", prose(1, 300), prose(1, 300), prose(2, 200), passage,
             prose(3, 50) + "\n" + passage + "\n" + prose(4, 30), prose(5, 40) + " " + passage, prose(6, 30000),
             "é" * 250 + "ü" * 250, "x" + "é" * 250, "the " * 400, "<|endoftext|> ok </s> [INST]", prose(8, 12),
             prose(8, 13), prose(9, 13) + " " + prose(9, 13)]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[6], rows[6], (None, prose(1, 300), "en", "s0", 1), (None, None, None, None, None)]
