"""Links of small vaults against a plain reading of the same text."""

import random
import re

import pytest

from convoweave.operators import link_check as LC

SCHEMA = "path string, section int, a string, b double, c string, line string"


def vault(spark, pages):
    return spark.createDataFrame([(p, s, None, float(i), None, line) for p, rows in pages.items() for i, (s, line) in enumerate(rows)], SCHEMA)


def key(x):
    return re.sub(r"[\[\]|#^\\]", "", x).strip(" ").lower()


def expected(pages):
    answers = {}
    for p, rows in pages.items():
        whole = re.sub(r"\.md$", "", p)
        mine = {key(whole), key(whole.rpartition("/")[2])}
        mine |= {key(m[1]) for s, x in rows if x and s <= 1 for m in re.finditer(r'(?m)^title: "(.*)"$', x)}
        for k in mine - {""}:
            answers.setdefault(k, set()).add(p)
    out = {}
    for p, rows in pages.items():
        for _, x in rows:
            for raw in re.findall(r"\[\[([^\[\]\n]+)\]\]", x or ""):
                t = key(re.sub(r"\.md\s*$", "", re.split(r"[|#]", raw)[0]))
                if t:
                    met = sorted(answers.get(t, ()), key=lambda q: (len(q), q))
                    n = out.get((p, t), (0,))[0] + 1
                    out[p, t] = (n, met[0] if met else None, len(met))
    return out


@pytest.fixture(scope="module")
def pages():
    r = random.Random(5)
    out = {}
    for k in range(60):
        folder = ("A/", "B/", "")[k % 3]
        rows = [(0, "---"), (1, f'title: "Note {k // 2}: \\"x\\" [y]"')] if k % 4 else [(0, f'---\ntitle: "Map {k}"\ntype: moc')]
        for _ in range(r.randrange(6)):
            t = r.choice(["Common", f"note-{r.randrange(70)}", f"NOTE-{r.randrange(70)}.md", f"A/note-{r.randrange(70)}", f'Note {r.randrange(40)}: "x" y', f"Map {r.randrange(70)}", "#Only Heading", "gone", "one, two"])
            rows.append((31, f"see ![[{t}]] and [[{t}#part|shown]]\nor [[ {t} ]] [[]] [[a\nb]] [x](y)"))
        out[f"{folder}note-{k - k % 2 if folder else k}.md"] = rows
    out["Common.md"] = [(31, None), (31, "")]
    out["deep/Common.md"] = [(31, "[[common]] " * 500)]
    return out


def test_links_and_report(spark, pages):
    rows = vault(spark, pages)
    got = {(r["path"], r["target"]): (r["n"], r["found"], r["pages"]) for r in LC.check(rows).collect()}
    want = expected(pages)
    assert got == want and {v[2] for v in want.values()} >= {0, 1, 2}
    quality = {r["path"]: r for r in LC.page_quality(rows, LC.check(rows)).collect()}
    assert set(quality) == set(pages)
    for p, q in quality.items():
        mine = [v for (path, _), v in want.items() if path == p]
        met = {path for (path, _), v in want.items() if v[1] == p and path != p}
        assert (q["links"], q["broken"], q["ambiguous"]) == (sum(v[0] for v in mine), sum(v[0] for v in mine if not v[2]), sum(v[0] for v in mine if v[2] > 1))
        assert (q["backlinks"], q["orphan"], q["n_lines"]) == (len(met), not met, sum(x is not None for _, x in pages[p]))
    checked = LC.check(rows)
    said = [r["line"] for r in LC.report_lines(checked, LC.page_quality(rows, checked)).orderBy("section", "b", "c").collect()]
    assert any(x.startswith("- `gone` (") for x in said) and any(x.startswith("- `common` (") and "the first is `Common.md`" in x for x in said)


def test_aliases_and_nothing(spark, pages):
    rows = vault(spark, {"x.md": [(31, "[[Nick]] [[other]]")], "y.md": [(31, "none")]})
    aliases = spark.createDataFrame([("y.md", "NICK"), ("missing.md", "other")], "path string, name string")
    assert {(r["target"], r["found"]) for r in LC.check(rows, aliases).collect()} == {("nick", "y.md"), ("other", None)}
    none = vault(spark, {"x.md": [(31, "x")]}).limit(0)
    assert LC.check(none).count() == 0
    assert LC.totals(LC.page_quality(none, LC.check(none))).first().asDict() == dict.fromkeys(("pages_checked", "links_checked", "links_broken", "links_ambiguous", "orphans"), 0)


def test_links_written_in_several_ways_have_a_row_each_as_in_the_twin(spark):
    rows = vault(spark, {"a.md": [(1, "[[Thing]] and [[thing]]"), (2, "[[thing]]")]})
    assert [(r["target"], r["n"]) for r in LC.check(rows).collect()] == [("thing", 3)]
    assert sorted((r["target"], r["n"]) for r in LC.check(rows, written=True).collect()) == [("thing", 1), ("thing", 2)]
