"""Small corpora with what operators must bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, _row string, kept string, node string, n_words string, `a.b c` string"


def words(rng: random.Random, n: int, vocabulary: int = 60) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def complements(n: int = 4096) -> tuple[str, str]:
    """Two words of n letters, each the other's complement, whose polynomial hashes modulo a power of two are one for every odd base (Thue-Morse)."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    shared = words(rng, 120, 5000)
    base = words(rng, 150, 5000)
    texts = [words(rng, rng.randrange(1, 300), 3000) for _ in range(30)]
    texts += [f"{words(rng, 30, 3000)} {shared} {words(rng, 40, 3000)}" for _ in range(4)]
    texts += [base, base, base.replace(" w1", " x1", 1), base + " tail", base.upper()]
    texts += [None, "", "   \n\t ", "one", "Été ß 日本 " * 60, "same " * 300, "A\nA\nB\n\nA", words(rng, 20_000, 9000), "\x00odd\x1fbytes\x7f" * 50]
    one, other = complements()
    lead = words(rng, 19, 5000)
    texts += [one, other, f"{lead} {one} {lead}", f"{lead} {other} end", f"{one} {lead}", f"{one[:1024]} {lead} {other[:1024]}", one[:600], other[:600]]
    found = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}") for i, t in enumerate(texts)]
    found += [found[3], found[3], (None, texts[5], None, None), (None, texts[6], "en", None), (3, "another text of a repeated id", "en", "s0")]
    return [(d, t, la, s, None if t is None else len(t), "x", "y", "z", "n", "0", "q") for d, t, la, s in found]


def frame(spark, seed: int = 1, own: list[tuple] | None = None):
    return spark.createDataFrame(rows(seed) if own is None else own, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
