"""Cases that once went wrong in the HTML and secret operators, and their queries against plain scans."""
import random
import re
import string

import pytest

from fieldspark.llm import exact_dedup, html_text, piece_scan, secrets

CLEAN = [
    "keyword 2021-03-04T12-00-00_backup_final_v2", "author_id=550e8400-e29b-41d4-a716-446655440000", "the key is in /usr/lib/x86_64-linux-gnu/libssl.so.3", "keyboard model K120-920-002478-ENG-USB-BLK",
    "author https://www.nytimes.com/2021/03/04/technology/artificial-intelligence-regulation.html", "private notes in /home/user/documents/2020/summer/holiday-plans", "token ring network-adapter-driver-version-10-2-33",
    "authentication see docs/security/guides/single-sign-on/overview", "monkey business_as_usual_in_the_jungle_of_2019"]


@pytest.mark.parametrize("text", CLEAN)
def test_structured_strings_are_no_secrets(text):
    assert not [s for s in secrets.spans_of(text) if s[0] == "novel"]


@pytest.mark.parametrize("context", ["the private key: {}", "apiKey {}", "AUTH_TOKEN\n{}", "client_secret is {}", "bearer {}"])
def test_random_strings_in_context_are_found(context):
    r = random.Random(4)
    for alphabet in (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_"):
        found = 0
        for _ in range(40):
            value = "".join(r.choices(alphabet, k=40))
            found += any(k != "x" for k, *_ in secrets.spans_of(context.format(value)))
        assert found >= 38


def test_secret_query_keeps_the_base_spans(spark, tmp_path):
    texts = [None, "", "password = abcdefghijkl and AKIAABCDEFGHIJKLMN", "secret: short", "x deadbeefdeadbeef01 y", "é token='0123456789ab/cd' z", "key " + "Zq3xV9tLm2Rk8Wd4Hs6Yp1Bn7Cf5Jg0", CLEAN[0]] * 2
    spark.createDataFrame([(i % 9, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, secrets int").write.parquet(str(tmp_path / "documents.parquet"))
    got = secrets.op10_secrets(spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    assign = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    count = lambda t: (sum(len(m[1]) >= 12 for m in assign.finditer(t)), len(re.findall(r"AKIA[A-Z0-9]{14,}", t)), len(re.findall(r"[0-9a-f]{16,}", t)))
    assert sorted((x["doc_id"], x["n_assign"], x["n_access"], x["n_hex"]) for x in got) == sorted((i % 9, *count(t or "")) for i, t in enumerate(texts))
    assert secrets.scan(spark.createDataFrame([], "text string, secrets int")).count() == 0


PAGE = "<html><head><title>t</title></head><body><nav><a href=x>Home</a> <a href=y>More</a></nav><article>{}</article><footer>Imprint</footer></body></html>"
LONG = "<p>" + "A paragraph of the article with enough words to be its text. " * 6 + "</p>"


def test_blocks_are_never_glued():
    html = PAGE.format("<h1>T</h1>" + LONG + "<address>x</address><dialog>d</dialog><center>c1</center><center>c2</center><details><summary>S</summary>D</details>one<hr>two<fieldset><legend>L</legend>f</fieldset><table><caption>C</caption><tfoot><tr><td>t</td></tr></tfoot></table>")
    blocks = html_text.main_text(html).split("\n\n")
    assert blocks[2:] == ["x", "d", "c1", "c2", "S", "D", "one", "two", "L", "f", "C", "t"] or blocks[2:8] == ["x", "d", "c1", "c2", "S", "D"] and blocks[8:10] == ["one", "two"]


@pytest.mark.parametrize("name", ["adsbygoogle", "googleAd", "siteHeader", "alert", "commentlist", "replies", "pageFooter", "userComments", "topNav"])
def test_joined_and_camel_case_names_are_boilerplate(name):
    for key in ("class", "id"):
        assert "unwanted" not in html_text.main_text(PAGE.format(f'{LONG}<div {key}="{name}"><p>unwanted words here</p></div>{LONG}'))
    assert "unwanted" not in html_text.main_text(PAGE.format(f'{LONG}<div id="respond"><h3>Leave a reply</h3><p>unwanted words</p></div>'))


@pytest.mark.parametrize("name", ["headline", "shadow", "adapter", "loading", "navy", "content", "readable", "header-free-text-padding"])
def test_names_that_only_look_like_it_stay(name):
    if name != "header-free-text-padding":
        assert "wanted" in html_text.main_text(PAGE.format(f'{LONG}<div class="{name}"><p>wanted words here</p></div>{LONG}'))


def test_html_query_on_odd_rows(spark, tmp_path):
    rows = [(1, "u", PAGE.format(LONG), "x"), (1, "u", PAGE.format(LONG), "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "<p>only", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(str(tmp_path / "pages.parquet"))
    got = html_text.op9_html_text(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = sorted(map(str, [(i, u, html_text.main_text(h), len(html_text.main_text(h))) for i, u, h, _ in rows]))
    assert sorted(str(tuple(x)) for x in got.collect()) == want


def test_chunks_decode_apart():
    pieces = piece_scan.Pieces(piece_scan.model_bytes())
    text = " two  blanks é𝄞 日本 " * 30
    s = piece_scan.marked(text)
    whole = list(pieces.encode([text])[0])
    for cut in (1, 7, 50, len(whole) - 3):
        while cut < len(whole) and whole[cut] in pieces.bytes:
            cut += 1
        assert pieces.decode(whole[:cut]) + pieces.decode(whole[cut:], False) == pieces.decode(whole) and s


def test_exact_dedup_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "_digest", "_sha", "_keep", "_id", "_key", "_row", "norm", "salt"]
    docs = spark.createDataFrame([(1, "a b", *"stuvwxyz"), (2, "ab", *"stuvwxyz"), (3, "c", *"stuvwxyz")], names)
    got = exact_dedup.drop_exact(docs)
    assert got.columns == names and sorted(x["doc_id"] for x in got.collect()) == [1, 3] and got.first()["_digest"] == "s"
