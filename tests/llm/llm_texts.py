"""Seeded texts for the tests."""
import random


def prose(seed: int, n: int, words: int = 400) -> str:
    """Plain seeded prose."""
    rng = random.Random(seed)
    parts = ["an", "be", "co", "di", "el", "fo", "gu", "hi", "lo", "mi", "na", "or", "pe", "ri", "sa", "tu"]
    vocabulary = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    out = []
    for k in range(n):
        out.append(rng.choice(vocabulary))
        if k % 12 == 11:
            out[-1] += ".\n" if k % 36 == 35 else "."
    return " ".join(out)
