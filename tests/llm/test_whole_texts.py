"""Inputs that an earlier cut left out."""

from itertools import combinations

import pytest

from gneiss.llm import html_extract, ngram_join


def words(name, n):
    return [f"{name}{i}" for i in range(n)]


def test_links_of_a_group_of_near_copies_are_all_there(spark):
    base = words("w", 200)
    texts = {k: " ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 180, 2)}
    texts |= {1000 + k: t for k, t in list(texts.items())[:3]} | {2000: " ".join(base[:100]), 2001: None, 2002: " ".join(words("z", 40))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sh = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    first = {}
    for k in sorted(texts):
        if texts[k]:
            first.setdefault(texts[k], k)
    sets = {k: sh(t) for t, k in first.items()}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert len(want) > 4000
    # the join counts links, and a text's copies are links of their own
    rows = {k: [j for j, u in texts.items() if u == t] for t, k in first.items()}
    near = {k: {b if a == k else a for a, b in want if k in (a, b)} for k in sets}
    got = {r["doc_id"]: (r["n_texts_linked"], r["n_links"]) for r in ngram_join.op3_ngram_join(docs).collect()}
    assert got == {j: (len(near[first[t]]), len(rows[first[t]]) - 1 + sum(len(rows[x]) for x in near[first[t]])) if t else (0, 0) for j, t in texts.items()}


@pytest.mark.parametrize("tag", ["div", "section", "ul", "blockquote"])
def test_article_keeps_what_stands_beside_its_largest_part(tag):
    item = "li" if tag == "ul" else "p"
    body = [f"Sentence {i} of the body, with some more words in it, and an end." for i in range(20)]
    inner = "".join(f"<{item}>{x}</{item}>" for x in body)
    lead = "A lead of some words, which tells what follows, in short."
    part = f"<h1>Headline</h1><p>{lead}</p><{tag}>{inner}</{tag}>"
    nav = "<nav>Menu</nav>"
    assert html_extract.main_text(f"<body>{nav}<article>{part}</article></body>") == "\n\n".join(["Headline", lead, *body])
    # without an article, what was selected by its path stays
    assert lead in html_extract.main_text(f"<body>{nav}<div>{part}</div></body>")
