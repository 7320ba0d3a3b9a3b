"""Small documents that hold every odd case, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(letters, rounds=10):
    word, other = letters
    for _ in range(rounds):
        word, other = word + other, other + word
    return word


def words(text):
    return WORD.findall(text or "")


def corpus(n=160, seed=1):
    """Rows (doc_id, text, lang, source, n_chars): copies, near copies, shared passages, odd and missing texts."""
    rng = random.Random(seed)
    vocabulary = {lang: ["".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(400)] for lang, letters in (("aa", "abcdefgh"), ("bb", "ijklmnop"), ("cc", "qrstuvéñ"))}
    passage = " ".join(rng.choices(vocabulary["aa"], k=70))
    rows = []
    for i in range(n):
        lang = rng.choice(list(vocabulary))
        kind = rng.random()
        made = rng.choices(vocabulary[lang], k=rng.choice([1, 3, 5, 12, 60, 130, 260]))
        text = " ".join(made)
        if kind < 0.15 and rows:
            text, lang = rows[rng.randrange(len(rows))][1:3]
        elif kind < 0.35 and rows:
            text, lang = rows[rng.randrange(len(rows))][1:3]
            part = words(text)
            for _ in range(max(1, len(part) // 60)):
                if part:
                    part[rng.randrange(len(part))] = "changed"
            text = " ".join(part)
        elif kind < 0.45:
            text = text + "\n" + passage + "\n" + text[:40]
        elif kind < 0.5:
            text = text.upper() + " ###$$$ |\n\n" + text + "\n" + text
        rows.append((i * 3, text, lang, f"s{i % 5}", len(text or "")))
    odd = [None, "", " \n\t ", "one", "a b c d", "x " * 300, "日本語 テキスト 😀   nbsp", "don't stop, it's <|endoftext|> 123  456\n\n", "z" * 5000, "\x0b\x0c"]
    # polynomial sums modulo a power of two can't tell these two apart, as letters or as words
    one, two = thue_morse("ab"), thue_morse("ba")
    odd += [one, two, f"say {one} {one} and {two}", *(" ".join(vocabulary["bb"][:30] + [x] + vocabulary["bb"][30:90]) for x in (one, two)), " ".join(one), " ".join(two)]
    odd += [f"{one}\n{two}\n{one}\n" + " ".join(vocabulary["cc"][:40]), ("ab" * 7 + " ") * 90, "wörter " * 4000 + one]
    rows += [(1000 + k, t, "aa", None, 0) for k, t in enumerate(odd)]
    rows += [(2000, "no language here at all", None, "s", 3), rows[3]]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def shingles(text, k=5):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_duplicate_components(rows):
    """{doc_id: (size of set, component)} by comparing all pairs."""
    sets = {}
    for r in rows:
        sets.setdefault(r[0], shingles(r[1]))
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def kept_words(rows, width=50):
    """{(doc_id, text): words and which of them stay}."""
    first = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(r[1])
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), r[0])
    out = {}
    for r in rows:
        w = words(r[1])
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if r[0] is not None and first[tuple(w[k : k + width])] < r[0]:
                gone[k : k + width] = [True] * width
        out[r[0], r[1]] = (w, gone)
    return out


def base_counts(text):
    t = text or ""
    w = words(t)
    seen, repeated = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            repeated |= set(range(i, i + 5))
    lines, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(repeated)]


def out_of_place(text, profiles, fold, depth=300):
    """(language, distance share) by the definition, with strings."""
    grams = Counter()
    word = ""
    for ch in (text or "") + " ":
        low = fold(ch)
        if low is None:
            if word:
                padded = f" {word} "
                for n in (1, 2, 3):
                    for i in range(len(padded) - n + 1):
                        if padded[i : i + n].strip():
                            grams[padded[i : i + n]] += 1
            word = ""
        else:
            word += low
    return grams


