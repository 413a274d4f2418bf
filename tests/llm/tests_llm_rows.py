import random


def text(seed, n, per_line=1000):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8))) for _ in range(n)]
    return " ".join(words)


def item():
    return text(77, 30)


def rows():
    base = text(1, 200)
    out = [(1, base, "en", "a", 0, "x"), (2, base + " more", "en", "a", 0, "x"), (30, text(5, 50) + " " + item(), "en", "b", 0, "x")]
    out += [(i, text(100 + i, 60), "en" if i % 2 else "fr", "abc"[i % 3], 0, "x") for i in range(3, 20)]
    out += [(90, None, "en", "a", 0, "x"), (91, "", "en", None, 0, "x"), (92, "123 456", None, "b", 0, "x")]
    return out
