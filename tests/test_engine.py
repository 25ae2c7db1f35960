"""The engine on a small tree of documents and code."""

import pytest

from docgraph.engine import Engine
from docgraph.operators import readers
from docgraph.sources import fixture

DOCS = {
    "docs/cart.md": "---\ntitle: Cart guide\naliases: [trolley, basket]\ntags: [shop/cart]\nupdated: 2024-05-03\n---\n# Ignored\n\nHow a cart works. More.\n\n## Limits\n\nSee [prices](prices.md) and [[Gone]].\n```\n## not a heading\n[[Fenced]]\n```\n",
    "docs/prices.md": "# Prices\n\nA price of a thing. The trolley asks for it.\n\n## Limits\n\n**Step 1** read\n",
    "notes.txt": "SHOP NOTES\ncreated: 2023-01-02\naliases: diary\nWe met. Then left.\n",
}


NOTES = {
    "n/discount.md": "---\ntitle: Discount rule\nupdated: 2024-05-03\n---\nWe agreed on rounding.\n",
    "n/old.md": "---\ntitle: Rounding\nupdated: 2024-05-03\n---\nAn old rule of the cart.\n",
    "n/new.md": "---\ntitle: Rounding again\nsupersedes: [Rounding]\nupdated: 2024-06-01\n---\nA new rule of the cart.\n",
    "n/cart.md": "# Cart guide\n\nThe same name as a page.\n",
}


@pytest.fixture(scope="module")
def engine(spark):
    files = spark.createDataFrame(sorted({**fixture.FILES, **DOCS}.items()), "path string, content string")
    return Engine.build(spark, files, spark.createDataFrame(sorted(NOTES.items()), "path string, content string"))


def test_notes_follow_what_they_are_named_by(engine):
    ids = {r["path"]: r["id"] for r in engine.pages.collect()}
    assert len(set(ids.values())) == len(ids) and ids["docs/cart.md"] == "cart_guide" and ids["n/cart.md"] == "cart_guide_2"
    tail = lambda q: [r["id"] for r in engine.answer(q).collect() if r["path"].startswith("n/")]
    assert tail("rounding total") == [ids["n/new.md"], ids["n/discount.md"]]  # the old one is superseded
    assert tail("what of 2024-05-03") == [ids["n/discount.md"]]
    assert tail("price") == []
    assert ids["n/discount.md"] in {r["id"] for r in engine.search("rounding", notes=True).collect()}
    assert not {r["id"] for r in engine.search("rounding rule").collect()} & {ids[p] for p in NOTES}
    assert ids["n/old.md"] in {r["id"] for r in engine.search("2024-05-03", notes=None).collect()}


def test_readers():
    page = readers.markdown("docs/cart.md", DOCS["docs/cart.md"])
    assert page[1:8] == ("Cart guide", "markdown", ["trolley", "basket"], ["shop/cart"], None, "2024-05-03", [])
    assert page[8] == "How a cart works." and page[9] == ["Limits"]
    assert readers.plain("notes.txt", DOCS["notes.txt"])[1:6] == ("Shop Notes", "text", ["diary"], [], "2023-01-02")
    assert readers.front_matter("---\na: b\nno end") == ({}, "---\na: b\nno end")
    assert readers.mask_code("a `b` ```c\n```\nx\n```\ny") == "a     ```c\n   \n \n   \ny"


def test_pages_have_unique_ids_and_edges(engine):
    ids = [r["id"] for r in engine.pages.collect()]
    assert len(ids) == len(set(ids)) == len(fixture.FILES) + len(DOCS) + len(NOTES)
    edges = {(r["src"], r["dst"], r["kind"]) for r in engine.edges.collect()}
    paths = {r["path"]: r["id"] for r in engine.pages.collect()}
    assert (paths["docs/cart.md"], paths["docs/prices.md"], "link") in edges
    assert (paths["docs/prices.md"], paths["docs/cart.md"], "mention") in edges
    assert (paths["shop/__init__.py"], paths["shop/cart.py"], "import") in edges
    assert sum(r["rank"] for r in engine.ranks.collect()) == pytest.approx(1)


def test_questions(engine):
    paths = {r["path"]: r["id"] for r in engine.pages.collect()}
    assert engine.search("cart guide").first()["id"] == paths["docs/cart.md"]
    assert engine.search("price_of", kind="code").first()["id"] == paths["shop/prices.py"]
    assert [r["id"] for r in engine.search("", tag="shop").collect()] == [paths["docs/cart.md"]]
    assert engine.search("").count() == 0
    assert engine.page("Prices").count() == 0 or engine.page("docs/prices.md").first()["id"] == paths["docs/prices.md"]
    assert engine.definitions("Cart::add").first()["page_id"] == "shop/cart.py"
    called = {r["id"].split("#")[0] for r in engine.callers("price_of").collect()}
    assert called == {paths["shop/cart.py"]}
    assert engine.calls("price_of").count() == 1
    near = engine.neighbors(paths["docs/cart.md"])
    assert paths["docs/prices.md"] in {r["id"] for r in near.collect()}
    assert sum(r["tokens"] for r in engine.neighbors(paths["docs/cart.md"], depth=2, tokens=30).collect()) <= 30
    assert [r["label"] for r in engine.doc_search("step 1").collect()] == ["Step 1"]
    assert engine.hint("please look at the cart total").count() >= 1 and engine.hint("x").count() == 0


def test_lint_and_rendering(engine):
    lint = engine.lint()
    assert [r["target"] for r in lint["broken"].collect()] == ["Gone"]
    whole = {r["id"]: r["page"] for r in engine.rendered().collect()}
    assert len(whole) == engine.pages.count()
    code = next(p for p in whole.values() if 'source: "shop/cart.py"' in p)
    assert "## Exports\n- `" in code and "## Imports\n- shop/" in code and "## Body\n```python\n" in code and code.endswith("## Notes\n_none yet_\n")
    assert "](docs_prices.md)" in next(p for p in whole.values() if 'source: "docs/cart.md"' in p)
    written = engine.pages.sparkSession.createDataFrame([("shop/cart.py", "# x\n\n## Notes\nkept by hand\n")], "source string, page string")
    assert engine.rendered(written).filter("page like '%kept by hand%'").count() == 1
    assert engine.fingerprints().select("fingerprint").distinct().count() == engine.pages.count()


def test_answers_show_lines_and_definitions(engine):
    paths = {r["path"]: r["id"] for r in engine.pages.collect()}
    got = engine.answer("cart total").collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
    shown = {r["path"]: [s["name"] for s in r["symbols"] or []] for r in got}
    assert "total" in shown["shop/cart.py"] and len(shown["shop/cart.py"]) <= 3
    named = engine.answer("price_of Cart::add").collect()
    assert [(r["path"], [s["name"] for s in r["symbols"]]) for r in named] == [("shop/prices.py", ["price_of"]), ("shop/cart.py", ["add"])]
    assert [r["name"] for r in engine.not_found("price_of no_such_thing").collect()] == ["no_such_thing"] and engine.not_found("plain words").count() == 0
    assert {r["id"] for r in engine.search("pricing").collect()} == {paths["docs/prices.md"], paths["shop/prices.py"]}  # by its stem
    assert "shop/prices.py:5-10  price_of" in "\n".join(r["line"] for r in engine.answer_lines("price_of").collect())
    assert paths["docs/prices.md"] in {r["id"] for r in engine.candidates("elsewhere/prices.md").collect()}
    lines = engine.hint_lines("please look at the cart total").collect()
    assert 1 <= len(lines) <= 8 and ("shop/cart.py", "total") in {(r["path"], r["name"]) for r in lines}
    assert engine.hint_lines("<note> cart total").count() == 0


def test_stems():
    from docgraph.functions.stem import english, stem

    pairs = "consistency consist conspicuously conspicu knackeries knackeri kneaded knead happiness happi ties tie gas gas hoping hope hopping hop generously generous rationally ration skies sky early earli agreed agre controlling control"
    words = pairs.split()
    assert [english(w) for w in words[::2]] == words[1::2]
    assert stem("mcp-running") == "mcp-run" and stem("сервери") == "сервери"
