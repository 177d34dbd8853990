"""Cases that the supplied tables lack: queries as units, metrics of labelled resolutions, phrases, wiki links, dates, numbers."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import strings as S
from marlstone.functions.text import blocks, query_terms
from marlstone.operators.cleanup import schema_array, schema_date, title_category
from marlstone.operators.etl import html_text_of
from marlstone.operators.filters import InvalidArgument, validate
from marlstone.operators.mentions import packets, resolved


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("q,units", [("加息 AI", [["加", "息"], ["ai"]]), ("加 息 ai", [["加"], ["息"], ["ai"]]), ("ＡＩ  don't 3.14 don't", [["ai"], ["don't"], ["3.14"]]), ("央行，加息!", [["央", "行"], ["加", "息"]]), ("", [])])
def test_query_terms(q, units):
    assert query_terms(q) == units


@pytest.mark.parametrize("text,date", [("on 2024/3/5 we", "2024-03-05"), ("As of 9 Sept. 2024", "2024-09-09"), ("DECEMBER 7, 2024", "2024-12-07"), ("31 Feb 2024", None), ("in March", None), ("2024.13.01", None)])
def test_explicit_date(spark, text, date):
    assert one(spark, F.date_format(S.explicit_date(F.lit(text)), "yyyy-MM-dd")) == date


@pytest.mark.parametrize("quote,found", [("on 2024年3月5日 it", True), ("Dated March 5th, 2024", True), ("5 Mar. 2024", True), ("2024/03/05", True), ("March 15, 2024", False), ("12024-03-05", False), ("5 March 2023", False)])
def test_date_quoted(spark, quote, found):
    assert one(spark, S.date_quoted(F.lit("2024-03-05"), F.lit(quote))) is found


def test_numbers(spark):
    assert one(spark, S.numbers(F.lit("up 1,234.50 from (12.30), +7.00 and .5 or 8"))) == ["1234.5", "-12.3", "7", ".5", "8"]


@pytest.mark.parametrize("raw,text", [("<p>Q<sup>2</sup>\n rose “5\\%” &amp; &lt;b&#62;<br/> it’s ＡＢ&nbsp;x</td>", "Q2 rose \"5%\" & <b> it's AB x"), ("&amp;lt; plain", "&lt; plain"), ("é &#x41;", "é A"), (None, None)])
def test_evidence_text(spark, raw, text):
    assert one(spark, S.evidence_text(F.lit(raw).cast("string"))) == text


@pytest.mark.parametrize("raw,slug", [("  Café -- A_b.c!", "cafe-a_b.c"), ("Straße Ünder", "straße-under"), ("加息 (AI)", "加息-ai"), ("", "")])
def test_slug(spark, raw, slug):
    assert one(spark, S.slug_segment(F.lit(raw))) == slug


@pytest.mark.parametrize("text,value", [('```json\n{"a": "x\ny"}\n```', '{"a": "x\\u000ay"}'), ('{"a": "\\n"}', '{"a": "\\n"}'), ('{"a": "x"', None), (None, None)])
def test_json_repair(text, value):
    assert S.repaired(text) == value


@pytest.mark.parametrize("title,category", [("CPI", "macro"), ("China Watch: Acme Inc", "macro"), ("Q2 results: meeting notes", "meeting"), ("20240102-GS-Acme (AAPL): inflation", "company"), ("Portfolio: sector", "strategy"), ("Outlook: earnings of all", "company"), ("Acme: event update", "event"), ("nothing", None)])
def test_title_category(spark, title, category):
    assert one(spark, title_category(F.lit(title))) == category


def test_schema(spark):
    assert one(spark, schema_array(F.array(F.lit("a"), F.lit(" "), F.lit(None).cast("string"), F.lit("b"), F.lit("a")))) == ["a", "b"]
    assert [one(spark, schema_date(F.lit(t))) for t in ("2024-02-29T10:00:00Z", "2023-02-29", "soon")] == ["2024-02-29", None, None]


def test_blocks_join_to_the_body():
    body = "a" * 1790 + "\n\n" + "b" * 2000 + "\n## PDF 第 2 页\n# Head\n" + "c" * 10 + "😀" * 1000
    found = blocks(body)
    assert "".join(t for *_, t in found) == body and all(len(t.encode("utf-16-le")) <= 3600 for *_, t in found)
    assert found[-1][2] == 2 and found[-1][3] == ["Head"] and body[found[1][0] : found[1][1]] == found[1][4]


@pytest.mark.parametrize("node", [{"field": "nothing", "op": "eq", "value": "x"}, {"field": "title", "op": "gte", "value": "2024-01-01"}, {"all": []}, {"any": [], "all": []}, {"field": "tags", "op": "exists", "value": "true"}, {"field": "region", "op": "contains_any", "value": ["x"]}, {"field": "published_at", "op": "lte", "value": "2024-02-30"}])
def test_refused_filters(node):
    with pytest.raises(InvalidArgument):
        validate(node)


@pytest.mark.parametrize("html,text", [("<title>a &amp;&amp;&amp</title><p>b</p>", "a &&&amp b"), ("x &lt;y&gt; &#39;z&#39; & w", "x <y> 'z' & w"), ("<p>AT&T", "AT&T"), ("a <b>b</b> R&amp", "a b R&amp"), (None, "")])
def test_html_text(spark, html, text):
    """References end with a semicolon; one that was cut stays, and so does what stands last."""
    assert one(spark, html_text_of(F.lit(html).cast("string"))) == text


def test_names_are_resolved_without_their_lists(spark):
    """However many entities share an alias, no list of them goes with a mention."""
    known = "entity_id string, type string, name string, aliases array<string>, market string, code string, issuer_id string"
    rows = [(f"entity:company:{k}", "company", f"Firm {k}", ["Shared"], None, None, None) for k in range(500)]
    registry_ = spark.createDataFrame([*rows, ("entity:security:7", "security", "Firm 7 Ord", ["HK:7"], "HK", "7", "entity:company:7")], known)
    names = ["shared", "firm 3", "firm 7 (hk:7)", "firm 3 (hk:7)", "nobody"]
    found = spark.createDataFrame([(f"doc:{k}", "company", x) for k, x in enumerate(names * 20)], "document_id string, type string, norm string")
    out = resolved(found, registry_)
    assert out.columns == ["type", "norm", "document_id", "status", "entity_id"] and out.count() == 100
    got = {r["norm"]: (r["status"], r["entity_id"]) for r in out.collect()}
    assert got["shared"] == ("ambiguous", None) and got["firm 3"] == ("curated", "entity:company:3") and got["firm 7 (hk:7)"] == ("curated", "entity:company:7")
    assert got["firm 3 (hk:7)"][0] == got["nobody"][0] == "observed"


def test_packets_split_the_texts_of_their_sample_only(spark):
    """Texts that stand in no packet are not split: a fourth document of a name, a copy, and one of a settled name."""

    @F.udf("array<string>")
    def split(text):
        if text.startswith("unread"):
            raise AssertionError("a text outside the sample was split")
        return text.split("/")

    texts = {1: "of Nobody & Co/rest", 2: "rest/nobody & co, and so on", 3: "none/of it", 4: "unread 4", 5: "unread 5", 6: "unread 6"}
    docs = spark.createDataFrame([(f"doc:{k}", k, "1" if k == 5 else str(k), t) for k, t in texts.items()], "document_id string, doc_id long, family_id string, text string")
    found = spark.createDataFrame([("company", "nobody & co", f"doc:{k}", "observed") for k in (1, 2, 3, 4, 5)] + [("company", "firm", "doc:6", "curated")], "type string, norm string, document_id string, status string")
    context = docs.select("document_id", F.posexplode(split("text")).alias("ordinal", "text"))
    got = sorted((r["document_id"], r["ordinal"], r["excerpt"]) for r in packets(found, docs, context, most=2, chars=20).collect())
    assert got == [("doc:1", 0, "of Nobody & Co"), ("doc:1", 1, "rest"), ("doc:2", 0, "rest"), ("doc:2", 1, "nobody & co, and so "), ("doc:3", 0, "none"), ("doc:3", 1, "of it")]


def test_names_of_mixed_scripts_are_collated(spark):
    """Han names by pinyin before Latin ones, umlauts beside their letters, among the tags of all pages."""
    from marlstone.operators.pages import QUERIES

    rows = QUERIES["o9_collated"](spark, "/root/testdata/sf0.001").orderBy("place").collect()
    names = [r["name"] for r in rows]
    assert [r["place"] for r in rows] == list(range(1, len(rows) + 1))
    assert [x for x in names if x in {"zebra", "Äpfel", "apfel", "Zoo", "北京", "上海", "广州"}] == ["北京", "广州", "上海", "apfel", "Äpfel", "zebra", "Zoo"]
    assert any(x.startswith("公司:") for x in names) and "lang:en" in names and len(names) > 37
