"""Small hostile tables and brute-force versions of the operators."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = " ".join(f"shared{i}" for i in range(60))


def texts() -> list[str | None]:
    """Nulls, empty and blank texts, copies, near copies, repeats, long, dense and odd texts."""
    plain = [" ".join(f"w{(i * 7 + j * j) % 211}" for j in range(5 + i % 40)) for i in range(60)]
    return [
        None, "", " \t\n", "a", "A", "a ", "naïve café x y", "x　y  z\n\n", "tab\tend\r\n", "\U0001f600 emoji \U0001f600", "<|endoftext|> it's", "we've  'll",
        *plain, plain[3] + " ", plain[3].upper(), plain[3], plain[4] + " more", *(f"head{i} {PASSAGE} tail{i * i}" for i in range(12)), PASSAGE, PASSAGE,
        "ab" * 400, "z" * 900, " ".join(f"long{i % 977}" for i in range(9000)), "word " * 3000, PASSAGE[:200], PASSAGE[100:310],
    ]


def rows() -> list[tuple]:
    """Documents with a null id, null sources, a repeated row and columns whose names might clash."""
    out = [(i * 3, t, "en", None if i % 9 == 0 else f"s{i % 4 if i % 3 else 0}", 0, "x", i) for i, t in enumerate(texts())]
    return [*out, out[20], (None, "null id", None, None, None, None, None), (9_000_000_000, "far id", "de", "\U0001f600", 1, "y", 2)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, length int"


def repeats(raw: list[bytes], size: int = 200) -> list[bytearray]:
    """A mark for every byte that a string of ``size`` bytes covers which starts anywhere else too."""
    starts = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    marks = [bytearray(len(b)) for b in raw]
    for b, mark in zip(raw, marks):
        for i in range(len(b) - size + 1):
            if starts[b[i : i + size]] > 1:
                mark[i : i + size] = b"\1" * size
    return marks


def simhash(text: str | None, shingle: int = 4) -> int:
    import xxhash

    words = WORD.findall((text or "").translate(LOW))
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(marks: list[int], ids: list[int | None], radius: int = 4) -> list[int | None]:
    parent = list(range(len(marks)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(marks))]
