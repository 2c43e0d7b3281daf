"""Texts and constants that several tests share."""

import random

TOKENIZERS = "/opt/tokenizers"


def random_text(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


EDGE_TEXTS = [None, "", " \n\t ", "one", "two words", "ünïcödé ﬁ 🙂 한국어", "a" * 5000,
              " ".join(["very"] * 3000 + ["long"] * 3000), "<|endoftext|> x", " nbsp "]
