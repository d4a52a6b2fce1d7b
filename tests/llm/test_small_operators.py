"""Chat formatting, line dedup, WARC, HTML text, piece encoding and language ID on small fixtures."""

import hashlib
import random
import uuid
from collections import Counter

import pytest

from tidemark.llm import chat_format, html_text, language_id, line_dedup, piece_encoding, warc
from tidemark.llm.common import Scratch, shared_dir

DOCS = "doc_id long, text string"


# --- chat formatting ------------------------------------------------------------------------------------

CONTROLS = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_sep|>", "<|im_end|>\n", "\\", "<", "[", "|", ">", "\n", "é", "<\\/s>", " "]


def test_chat_round_trip(spark):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "a\nb%0A"]), "".join(rnd.choices(CONTROLS, k=rnd.randint(0, 6)))) for c in range(60) for t in range(rnd.randint(1, 7))]
    rows += [(100, 0, None, None), (100, None, "assistant", ""), (101, 1, "assistant", "x"), (101, 1, "assistant", "x"), (None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumnsRenamed({}).selectExpr("*", "1 AS turns", "2 AS formatted")
    got = {r["conv_id"]: r for r in chat_format.read_conversations(chat_format.format_conversations(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t), role or "", text or "") for c, t, role, text in rows if c == conv)
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r, x) for _, r, x in own]
        assert got[conv]["loss_text"] == "".join(x for _, r, x in own if r == "assistant")
        body = got[conv]["formatted"].replace("<|im_start|>", "").replace("<|im_sep|>", "").replace("<|im_end|>", "")
        assert not any(c in body for c in CONTROLS[:8])


def test_chat_merges_adjacent_roles(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn int, role string, text string")
    assert chat_format.format_conversations(df).first()["formatted"] == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_chat_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "PART", 64)
    rows = [(1, t, "assistant" if t % 3 else "user", f"turn {t} </s>" + "é" * (t % 5)) for t in range(3000)] + [(2, 0, "assistant", "x" * 400_000 + "[INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.read_conversations(chat_format.format_conversations(df)).collect()}
    for conv in (1, 2):
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r, x) for c, _, r, x in rows if c == conv]
        assert got[conv]["loss_text"] == "".join(x for c, _, r, x in rows if c == conv and r == "assistant")


# --- line dedup -----------------------------------------------------------------------------------------


def brute_lines(docs, min_chars=20, min_docs=3):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))
    held = {}
    for d, text in docs:
        for line in (text or "").split("\n"):
            if d is not None and len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(d)
    common = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if d is None or key(x) not in common or common[key(x)] == d]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup(spark):
    rnd = random.Random(5)
    pool = [f"  Line number {i} of some length {'É' * (i % 3)}\t" for i in range(12)] + ["short", "", "x" * 19, "y" * 20, "\x85" + "z" * 25]
    docs = [(i, "\n".join(rnd.choices(pool, k=rnd.randint(0, 9)))) for i in range(80)] + [(7, "y" * 20), (None, pool[0]), (90, None), (91, ""), (79, pool[1]), (79, pool[1])]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "0 AS h1", "1 AS kept", "2 AS holder")
    for batches, fanout in ((4, 2), (1, 2)):
        scratch = Scratch(spark)
        got = scratch.finish(line_dedup.dedup_lines(df, scratch, batches=batches, fanout=fanout)).collect()
        assert Counter((r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in got) == Counter(brute_lines(docs))
    scratch = Scratch(spark)
    assert scratch.finish(line_dedup.dedup_lines(df.limit(0), scratch)).count() == 0


def test_line_dedup_of_long_documents(spark):
    """Documents that share tens of thousands of lines, and one long line."""
    lines = [f"a shared line of the long documents {i}" for i in range(20_000)]
    docs = [(i, "\n".join([f"own {i}", *lines, "own"])) for i in range(3)] + [(9, "z" * 300_000)]
    scratch = Scratch(spark)
    got = {r["doc_id"]: r for r in scratch.finish(line_dedup.dedup_lines(spark.createDataFrame(docs, DOCS), scratch)).collect()}
    assert [got[i]["n_dropped"] for i in (0, 1, 2, 9)] == [20_000, 20_000, 0, 0]
    assert got[0]["kept_text"] == "own 0\nown" and got[2]["kept_text"] == docs[2][1] and got[9]["kept_text"] == docs[3][1]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark_run")]


# --- WARC -----------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big, other = "<p>é</p>" * 300, "<b>x</b>" * 400
    pages = [(1, "http://a", big), (2, "http://b c\r\nX: y", big), (9, "u", big), (3, "u", "tiny"), (4, "u", "tiny"), (5, "u", None), (6, None, ""), (7, "u", other), (8, "u", other), (8, "u", other), (None, "n", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS kind")
    uri = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = warc.write_archives(df, uri, roll_bytes=200, shard_bytes=4000)
    files = {r["file"]: r["sha256"] for r in manifest.collect()}
    assert len(files) > 3 and sum(r["records"] for r in manifest.collect()) == len(pages)
    got = warc.read_archives(spark, uri).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter((p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for p, _, h in pages)
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == {
        (1, "revisit", 9), (2, "revisit", 9), (9, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None),
        (7, "revisit", 8), (8, "response", None), (None, "response", None),
    }
    assert {r["page_id"]: r["payload"].decode() for r in got if r["payload"] is not None}[9] == big
    assert Counter(r["url"] for r in got) == Counter(u for _, u, _ in pages)
    again = warc.write_archives(df.repartition(3), f"{uri}-2", roll_bytes=200, shard_bytes=4000)
    assert {r["file"]: r["sha256"] for r in again.collect()} == files
    empty = f"{uri}-3"
    assert warc.write_archives(df.limit(0), empty).count() == 0 and warc.read_archives(spark, empty).count() == 0


def test_warc_ids_far_apart(spark):
    """Shards follow sizes wherever ids lie; many rows of one id, or of none, are dealt."""
    pages = [(i, "u", f"<p>{i}</p>" * 20) for i in [*range(300), 10**12, -(2**63), 2**63 - 1, -9 * 10**18]] + [(7, "u", f"{i}" * 80) for i in range(200)] + [(None, "u", f"n{i}" * 50) for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    uri = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = warc.write_archives(df, uri, shard_bytes=20_000).collect()
    records = Counter()
    for r in files:
        records[r["shard"]] += r["records"]
    assert sum(records.values()) == len(pages) and len(records) > 12 and max(records.values()) < 120
    got = warc.read_archives(spark, uri).collect()
    assert Counter((r["page_id"], r["payload"].decode()) for r in got) == Counter((p, h) for p, _, h in pages)
    assert {(r["file"], r["sha256"]) for r in files} == {(r["file"], r["sha256"]) for r in warc.write_archives(df.repartition(5), f"{uri}-2", shard_bytes=20_000).collect()}


def test_warc_records_are_standard():
    raw = warc.record(5, 0, "http://a", b"<p>x</p>", hashlib.sha1(b"<p>x</p>").hexdigest(), None)
    head, _, rest = raw.partition(b"\r\n\r\n")
    assert b"Content-Type: application/http; msgtype=response" in head and rest.startswith(b"HTTP/1.1 200 OK\r\n") and rest.endswith(b"\r\n\r\n<p>x</p>\r\n\r\n")
    assert warc.parse(raw)["payload"] == b"<p>x</p>" and warc.parse(warc.file_info("f")) is None
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"<p>x</p>", b"<p>y</p>"))


# --- HTML -----------------------------------------------------------------------------------------------

ARTICLE = "<h1>Title</h1><p>A long first paragraph with many words, &amp; some <b>bold\n\t text</b>.<p>Short.</p><ul><li>one<li>two</ul><p>Another long one,<br>broken in two.</p>"
WANT = "Title\n\nA long first paragraph with many words, & some bold text.\n\nShort.\n\none\n\ntwo\n\nAnother long one, broken in two."


@pytest.mark.parametrize("outer", ["<article>{}</article>", "<main><div>{}</div></main>", "<div id=content><div class=post>{}</div></div>", "<div itemprop=articleBody>{}</div>"])
def test_html_main_text(outer):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>'</script></head><body><header><h1>Site</h1><p>Motto of the site, rather long indeed</p></header><nav><ul><li><a href=/>Home</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies and say so at length, at great length.</div><!-- ad --><div class=ad>Buy</div>"
        + outer.format(ARTICLE + "<div class='ad'>Buy now</div><form><input><label>Name</label></form>")
        + "<aside>Elsewhere</aside><div id=comments><p>A reader's very long comment, as long as the longest paragraph of the article.</p></div><footer>&copy; all</footer></body></html>"
    )
    assert html_text.main_text(page) == WANT


def test_html_edges(spark):
    assert [html_text.main_text(x) for x in (None, "", "<nav>a</nav>", "just text", "<p>a<p>b", "a < b <3", "<article><p>" + "word " * 50_000)] == ["", "", "", "just text", "a\n\nb", "a < b <3", ("word " * 50_000).strip()]
    df = spark.createDataFrame([(1, "u", None), (1, "u", "<p>x</p>")], "page_id long, url string, html string").selectExpr("*", "3 AS main_text", "4 AS text")
    assert sorted(r["main_text"] for r in html_text.extract(df).collect()) == ["", "x"]
    assert html_text.extract(df.limit(0)).count() == 0


# --- pieces ---------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark):
    encoder = piece_encoding.Encoder(piece_encoding.model_path(), cache=500)
    library = encoder.vocabulary.library
    rnd = random.Random(1)
    alphabet = list("ab the\n\n  \t▁éß中🙂\x00 <>0x") + ["<s>", "</s>", "<0x0A>", "tion", "  ", "\r\n", "ﬁ", "\x85"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 60))) for _ in range(3000)] + ["", "a" * 5000, " " * 300, "\n" * 50, "ab" * 40 + " x"]
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        for text, (ids, said) in zip(part, encoder.encode(part), strict=True):
            assert ids == library.encode(text, add_eos=True), text
            assert said == " ".join(map(str, ids))
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello  world\n"), (3, "Hello  world\n")], DOCS).selectExpr("*", "0 AS ids", "1 AS batch_checked")
    got = {r["doc_id"]: r for r in piece_encoding.encode_documents(df, with_ids=True).collect()}
    assert got[1]["ids"] == got[2]["ids"] == [library.eos_id()] and got[1]["decoded"] == ""
    assert got[3]["ids"] == library.encode("Hello  world\n", add_eos=True) and got[3]["decoded"] == "Hello  world\n" and got[3]["batch_checked"]
    assert piece_encoding.encode_documents(df.limit(0)).count() == 0


# --- language -------------------------------------------------------------------------------------------

WORDS = {"en": "the of and to in is that for with was on are this from".split(), "de": "der die und das nicht ist von mit zu den auf für".split(), "fr": "le la les des que pour dans une est pas sur avec".split()}


def test_language(spark):
    rnd = random.Random(2)
    make = lambda lang, n: " ".join(rnd.choices(WORDS[lang], k=n)) + "."
    train = [(i, make(lang, 60), lang) for i in range(60) for lang in WORDS] + [(None, "x", "en"), (1, None, "de"), (2, "", "fr"), (3, "zz", None)]
    model = language_id.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert set(model) == set(WORDS)
    test = [(make(lang, 25), lang) for _ in range(30) for lang in WORDS]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(test)] + [(-1, None), (-2, ""), (-3, "123 !"), (-4, "the " * 30_000)], DOCS).selectExpr("*", "0 AS lang_pred")
    got = {r["doc_id"]: r for r in language_id.predict(rows, model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, (_, lang) in enumerate(test)) >= 0.97 * len(test)
    assert all(got[i]["lang_pred"] == "und" and got[i]["lang_score"] == 0 and got[i]["lang_rejected"] for i in (-1, -2, -3))
    assert got[-4]["lang_pred"] == "en" and all(0 <= r["lang_score"] <= 1 for r in got.values())
    assert language_id.predict(rows.limit(0), model).count() == 0
    assert language_id.learn(rows.selectExpr("doc_id", "text", "cast(null as string) AS lang")) == {}
    assert language_id.predict(rows, {}).where("lang_pred <> 'und'").count() == 0


def test_language_by_compressed_sizes(spark):
    """Predictions follow the sizes of frames, compressed here in a plain loop; numerals are no letters; near ties are rejected."""
    import zstandard

    rnd = random.Random(4)
    train = [(i, " ".join(rnd.choices(WORDS[lang], k=80)), lang) for i, lang in enumerate(list(WORDS) * 40)] + [(5000 + i, f"wort{i} " * 30, f"l{i}") for i in range(300)]
    model = language_id.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert len(model) == 303
    model = {lang: model[lang] for lang in WORDS}
    texts = [" ".join(rnd.choices(WORDS[rnd.choice(list(WORDS))], k=rnd.randint(1, 900))) for _ in range(60)] + ["½", "10²", "Ⅷ", "①②③", "x"]
    got = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame(list(enumerate(texts)), DOCS), model).collect()}
    for i, text in enumerate(texts):
        if not any(c.isalpha() for c in text):
            assert got[i]["lang_pred"] == "und" and got[i]["lang_rejected"]
            continue
        raw, sizes = text.encode(), {}
        for lang, dictionary in model.items():
            d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[lang] = sum(len(zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_dict_id=False).compress(raw[k : k + 4096])) for k in range(0, len(raw), 4096))
        least, second = sorted(sizes.values())[:2]
        assert sizes[got[i]["lang_pred"]] == least
        assert got[i]["lang_rejected"] == (second - least < max(2, 0.002 * least))
    assert got[len(texts) - 1]["lang_rejected"]


# --- generated pages -------------------------------------------------------------------------------------


def generated_page(rnd):
    """(page, the article's text) with a layout, inline markup, references and surroundings at random."""
    word = lambda: "".join(rnd.choices("abcdefghiklmnoprstu", k=rnd.randint(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + rnd.choice([".", ".", "?", " & so on.", " <b> is a tag."])
    escape = lambda t: t.replace("&", rnd.choice(["&amp;", "&#38;", "&#x26;"])).replace("<", "&lt;").replace(">", "&gt;")

    def inline(text):
        out = []
        for w in text.split(" "):
            w = escape(w)
            kind = rnd.random()
            out.append(f"<a href='/x'>{w}</a>" if kind < 0.03 else f"<b>{w}</b>" if kind < 0.06 else f"<span class='term'>{w}</span>" if kind < 0.08 else w)
        return rnd.choice([" ", "\n", "  ", " "]).join(out)

    blocks, html = [], []

    def add(tag, text, **attrs):
        blocks.append(text)
        named = "".join(f' {k}="{v}"' for k, v in attrs.items())
        html.append(f"<{tag}{named}>{inline(text)}</{tag}>" if tag != "p" or rnd.random() < 0.8 else f"<p{named}>{inline(text)}")

    add("h1", sentence(5))
    for name in rnd.sample(["discussion", "related-work", "search-algorithms", "legal-analysis", "side-effects", "alert-levels", "popular-science", "method", "results"], rnd.randint(2, 5)):
        wrap = rnd.random() < 0.5
        if wrap:
            html.append(f'<section id="{name}">')
        add("h2", sentence(3), **({} if wrap else {"id": name}))
        for _ in range(rnd.randint(1, 4)):
            add("p", " ".join(sentence(rnd.randint(6, 25)) for _ in range(rnd.randint(1, 4))))
            if rnd.random() < 0.2:
                html.append("<ul>")
                for _ in range(rnd.randint(2, 4)):
                    add("li", sentence(rnd.randint(3, 9)))
                html.append("</ul>")
            if rnd.random() < 0.1:
                add("p", sentence(2))
            if rnd.random() < 0.2:
                html.append(rnd.choice(['<div class="ad">Buy this now</div>', "<script>var x = '<p>no</p>';</script>", "<style>p{color:red}</style>", "<!-- <p>no</p> -->", "<form><label>Your name</label><input name=a></form>"]))
        if wrap:
            html.append("</section>")
    if rnd.random() < 0.3:
        html.append("<ul class=more>" + "".join(f"<li><a href=/{i}>{sentence(5)}</a></li>" for i in range(30)) + "</ul>")
        add("p", " ".join(sentence(20) for _ in range(2)))
    links = lambda n: "<ul>" + "".join(f"<li><a href=/{i}>{word()}</a></li>" for i in range(n)) + "</ul>"
    article = rnd.choice(["<article>{}</article>", "<main>{}</main>", "<main><article class=post>{}</article></main>", "<div id=content><div class=entry>{}</div></div>", "<div role=main>{}</div>"]).format("\n".join(html))
    before = [f"<nav>{links(6)}</nav>", f"<header><p>{sentence(6)}</p></header>", f"<div class='cookie-notice'>{sentence(30)}</div>", f"<div class='navbar'>{links(9)}</div>", f"<div class=ad>{sentence(8)}</div>"]
    after = [f"<aside>{sentence(20)}</aside>", f"<div class=sidebar>{links(12)}<p>{sentence(15)}</p></div>", f"<footer><p>{sentence(12)}</p></footer>", f"<div id=comments><p>{sentence(40)}</p><p>{sentence(30)}</p></div>", f"<div class='newsletter-signup'><p>{sentence(9)}</p></div>"]
    rnd.shuffle(before)
    rnd.shuffle(after)
    page = f"<!DOCTYPE html><html><head><title>{word()}</title></head><body>{''.join(before[:4])}{article}{''.join(after[:4])}</body></html>"
    return page, "\n\n".join(blocks)


def test_generated_pages():
    rnd = random.Random(21)
    for _ in range(300):
        page, want = generated_page(rnd)
        assert html_text.main_text(page) == want, page


@pytest.mark.parametrize(
    "broken",
    ["<div><p>x" * 40_000, "<p><table>" + "<b><ul>x" * 40_000, "<span><dd>x" * 40_000, "<div>" * 40_000 + "</span>x" * 40_000, "<!-- " * 100_000, "<div a=" * 100_000, "<![CDATA[" * 60_000 + ">", "<" * 500_000, "<article>" + "<header><h1>x" * 40_000],
)
def test_broken_markup_takes_linear_time(broken):
    import time

    began = time.process_time()
    html_text.main_text(broken)
    assert time.process_time() - began < 10
