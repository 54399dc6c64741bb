"""Blocks, candidates and JSON trees against plain walks."""

import json
import random
import re

from veldspar.sources import content, json_tree


def walk(html):
    """Blocks of a page, a token at a time."""
    out, now, tag, depth, link = [], None, None, dict.fromkeys(("skip", "article", "main"), 0), False
    for token in re.findall(content.TOKENS.replace("(?i:", "(?:"), html or "", re.I):
        m = re.match(r"</?([a-zA-Z][a-zA-Z0-9]*)", token)
        if re.match(r"<[!?/a-zA-Z]", token):
            name, shut = (m.group(1).lower(), token.startswith("</")) if m else ("", False)
            if name in content.BLOCKS:
                now, tag = None, ("/" if shut else "") + name
            if name == "a":
                link = not shut
            for part, names in (("skip", content.SKIPPED), ("article", ["article"]), ("main", ["main"])):
                depth[part] += (name in names) * (-1 if shut else 1)
            continue
        if now is None:
            now = {"raw": "", "n": 0, "linked": 0, "tag": tag, "skip": False, "article": False, "main": False}
            out.append(now)
        now["raw"] += token
        now["n"] += len(token)
        now["linked"] += len(token) * link
        for part in depth:
            now[part] |= depth[part] > 0
    for b in out:
        for entity, c in content.ENTITIES:
            b["raw"] = b["raw"].replace(entity, c)
        b["text"] = re.sub("[ \t\r\n\f]+", " ", b["raw"]).strip(" ")
    out = [b for b in out if b["text"]]
    own = [0.0 if b["skip"] else len(b["text"].split(" ")) * (1 - b["linked"] / b["n"]) for b in out]
    for k, b in enumerate(out):
        b["score"] = own[k] + ((own[k - 1] if k else 0.0) + (own[k + 1] if k + 1 < len(own) else 0.0)) / 2
    return out


def random_page(rng):
    words = lambda n: " ".join(rng.choice(["strike", "mine", "a&amp;b", "café", "1 < 2", "x&nbsp;y"]) for _ in range(n))
    part = lambda: rng.choice([f"<p>{words(rng.randint(1, 40))}</p>", f"<p>{words(3)}<p>{words(30)}<br>", f"<li><a href=x>{words(4)}</a></li>", f"<DIV class='a>b'>{words(20)} <b>bold</b></DIV>", "<!-- <p>no</p> -->", "<script>var t='</p>';</script>", f"<nav>{words(9)}</nav>", f"<aside><p>{words(30)}</p></aside>", f"<h2>{words(5)}</h2>", "<", "</p>"])
    body = "".join(part() for _ in range(rng.randint(0, 14)))
    around = rng.choice(["{}", "<article>{}</article>", "<main>{}</main><p>out</p>", "<main><article>{}</article></main>", "<article>{}"])
    return f"<html><head><title>t</title></head><body>{around.format(body)}{part()}</body></html>"


def test_blocks_equal_a_walk(spark):
    rng = random.Random(1)
    pages = [(i, random_page(rng)) for i in range(80)] + [(100, None), (101, ""), (102, "plain"), (103, "<p"), (104, "<p>" * 500 + "x"), (105, "</nav>" + "<p>words</p>")]
    df = spark.createDataFrame([(i, h, "x") for i, h in pages], "page long, html string, text string")
    got = {}
    for r in content.scored(content.blocks(df, "page", "html")).collect():
        got.setdefault(r.id, []).append(r)
    for i, html in pages:
        rows = sorted(got.get(i, []), key=lambda r: r.block)
        assert [(r.text, r.tag, r.skipped, r.in_article, r.in_main, round(r.score, 9)) for r in rows] == [(b["text"], b["tag"], b["skip"], b["article"], b["main"], round(b["score"], 9)) for b in walk(html)]


def test_candidates_in_order(spark):
    long, short = "word " * 90, "brief " * 5
    body = json.dumps({"@graph": [{"a": [{"articleBody": "body " * 85}]}, {"articleBody": 7}]})
    linked = f'<script type="application/ld+json">{body}</script>'
    pages = [
        (1, f"<article><p>{long}</p></article>"), (2, f"{linked}<p>{short}</p>"), (3, f"<main><div>{'x ' * 200}</div><div>{short}</div></main><p>{short}</p>"), (4, f"<p>{short}</p>"), (5, "<nav>menu</nav>"), (6, None),
        (7, f"<article><ul>{'<li><a href=/>' + 'link ' * 20 + '</a></li>'}" + "<li><a href=/>link</a></li>" * 90 + "</ul></article>"), (8, '<script type="application/ld+json">{broken</script><p>one</p>'),
    ]
    got = {r.id: r for r in content.main_texts(spark.createDataFrame(pages, "id long, html string"), "id", "html").collect()}
    name = lambda r: r and (r.extractor, r.words)
    assert (name(got[1].first), name(got[1].longest), got[1].candidates) == (("density", 90), ("density", 90), 1)  # article and paragraphs give the same text
    assert (name(got[2].first), got[2].candidates) == (("json_ld", 85), 2) and got[2].longest.extractor == "json_ld"
    assert (name(got[3].first), name(got[3].longest)) == (("density", 205), ("density", 205)) and got[3].candidates == 1
    assert name(got[4].first) == ("paragraphs", 5) and got[5].first is None and got[6].candidates == 0
    assert name(got[7].longest) == ("article", 110) and name(got[8].first) == ("paragraphs", 1)


def leaf_walk(x, path=(), name=None):
    if isinstance(x, dict):
        for k in sorted(x):
            yield from leaf_walk(x[k], (*path, k), k)
    elif isinstance(x, list):
        for k, v in enumerate(x):
            yield from leaf_walk(v, (*path, f"{k:010d}"), name)
    else:
        yield path, name, x


def test_leaves_equal_a_walk(spark):
    rng = random.Random(2)

    def value(depth):
        kind = rng.randrange(6 if depth < 5 else 4)
        return [rng.randint(-9, 10**12), rng.choice(["", "a b", "é\n\"q\""]), rng.random() < 0.5, None, {}, []][kind] if kind < 4 else {rng.choice("abcd") + str(j): value(depth + 1) for j in range(rng.randint(0, 3))} if kind == 4 else [value(depth + 1) for _ in range(rng.randint(0, 12))]

    texts = [(i, json.dumps(value(0))) for i in range(60)] + [(90, "{bad"), (91, None), (92, ""), (93, '{"a": ' * 30 + "1" + "}" * 30), (94, "[[], {}]")]
    df = spark.createDataFrame(texts, "doc long, j string")
    got = {}
    for r in json_tree.leaves(df, "doc", "j").collect():
        got.setdefault(r.doc, []).append((tuple(r.path), r.name, r.value))
    show = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    want = {}
    for i, j in texts:
        try:
            rows = [(p, n, show(v)) for p, n, v in leaf_walk(json.loads(j or "bad"))]
        except ValueError:
            continue
        if rows:
            want[i] = sorted(rows, key=repr)
    assert {i: sorted(rows, key=repr) for i, rows in got.items()} == want
    flat = {r.doc: r.text for r in json_tree.flattened(df, "doc", "j").collect()}
    assert flat == {i: "\n".join(v for _, _, v in sorted(rows, key=lambda r: r[0]) if v is not None) for i, rows in want.items() if any(v is not None for _, _, v in rows)}


def test_no_python_worker(spark):
    df = spark.createDataFrame([(1, '{"a": [1]}')], "id long, j string")
    plan = json_tree.leaves(df, "id", "j")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
