"""Helpers of the tests: plain Python forms of the words, and texts with ties, repeats and odd splits."""

import random
import re

# Words that make ties, repeats and odd splits likely.
WORDS = ["a", "the", "The", "MIT", "é", "ÉA", "x-y", "under", "license", "12", "日本", "z!", "Σ"]
EXTRA = "doc_id long, text string, n_words string, score string, kept string, oid long, spans int"


def text_of(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", "\n", "\t", "  "]) for _ in range(n))


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))
