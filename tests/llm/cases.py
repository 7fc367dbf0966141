"""Documents that every operator must handle, and plain versions of what operators compute."""

from __future__ import annotations

import random
import re

PASSAGE = "one passage of words that many of the documents share, long enough to be cut from all but the first of them; it goes on for a while and ends here."


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeiourstnlmédßñ") for _ in range(rng.randint(1, 9))) for _ in range(n))


def rows() -> list[tuple]:
    """doc_id, text, lang, source, n_chars: nulls, empty and very long texts, repeated rows, copies, odd letters."""
    texts = [
        *(words(n, n) for n in (1, 2, 3, 4, 5, 6, 40, 200, 9000)),
        None, "", " ", "\n\t ", "a", "é", "\x00", "Ünï😀cödé ﬁ İ Σ", "x" * 5000, " " * 3000, "<|endoftext|> and <|startoftext|>",
        *[words(60, 7)] * 5, *[f"{words(30, 100 + i)} {PASSAGE} {words(20, 200 + i)}" for i in range(6)],
        *[f"{words(80, 9)} {i} {words(80, 10)}" for i in range(5)],
    ]
    out = [(i * 3 + 1, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[6], (None, "a row without an id", None, None, None), (10**12, words(50, 3), None, "src0", 7)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tokens(text: str | None) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)
