"""Small tables with every awkward case."""

LONG = " ".join(f"Wort{i % 700} Ünd, the'll {i}" for i in range(3000))
TEXTS = [
    None, "", "a", "A", "one two three four five six seven eight nine ten eleven twelve",
    "one two three four five six seven eight nine ten eleven twelve", "One two  three\tfour five six seven eight nine ten eleven twelve",
    "one two three four five six seven eight nine ten eleven thirteen", LONG, LONG + " end", "  leading and trailing  ", "\n\n", "héllo wörld ñandú", "日本語 テキスト mixed text",
    "it's <|endoftext|> here", "THE!! WORDS!! ARE!! LOUD!!", "tabs\tand\x0bother\x0cspaces\r\n", "İstanbul ŉ ﬁ é", "don't can't won't",
]


def documents(spark, texts=TEXTS, first=0):
    """doc_id and text, beside columns whose names the operators use inside."""
    rows = [(first + i, t, "en", "src0", i, "x", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, digest string, rank int")


def shingle_sets(rows, words):
    out = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        n = min(words, len(w))
        out[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    return out


def brute_components(rows, words, percent):
    sets = shingle_sets(rows, words)
    name = {d: d for d in sets}

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                name[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}
