import hashlib
import random

import pytest

from twinsift.llm import chat, queries, token_counts, url_filter


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|x|>", "<\\\\|", "a < | b", "<|im_start|>user\nhi<|im_end|>\n", "<<|", "\\", "<|image:0|>"])
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_conversations_read_back(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "user", "a"), (2, 0, None, None), (2, 1, "assistant", ""), (None, 0, "user", "x"), (1, 2, "ass\nistant", "c"), (1, 1, "assistant", "b<|im_end|>")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(df)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got.keys() == {1, 2, None}
    assert got[1]["n_turns"] == 4 and got[1]["loss_chars"] == 22
    assert got[1]["loss_sha256"] == sha("b<|im_end|>" * 2)
    assert got[1]["turns_sha256"] == sha("user\na\nassistant\nb<|im_end|>\nassistant\nb<|im_end|>\nass\nistant\nc\n")
    assert got[2]["turns_sha256"] == sha("\n\nassistant\n\n")
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0


def test_neighbouring_large_ids_stay_apart_beside_nulls(spark):
    rows = [(None, 0, "user", "x")] + [(2**60 + i, t, "assistant", f"{i} {t}") for i in range(1, 6) for t in (0, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = {r["conv_id"]: r["n_turns"] for r in chat.digest(chat.format_conversations(df)).collect()}
    assert got == {None: 1} | {2**60 + i: 2 for i in range(1, 6)}
    pages = spark.createDataFrame([(None, None)] + [(2**60 + i, "http://a.example.org/es/") for i in range(1, 6)], "page_id long, url string").coalesce(1)
    judged = url_filter.judge_urls(pages, spark.createDataFrame(queries.URL_RULES, url_filter.RULES)).collect()
    long = spark.createDataFrame([(1, "http://example.org/es/" + "x" * 1_000_000), (1, "http://example.org/es/" + "x" * 1_000_000)], "page_id long, url string")
    whole = url_filter.judge_urls(long, spark.createDataFrame(queries.URL_RULES, url_filter.RULES)).collect()
    assert [(r["page_id"], len(r["path"]), r["verdict"]) for r in whole] == [(1, 1_000_004, "block")] * 2
    assert {r["page_id"]: r["rule"] for r in judged} == {None: None} | {2**60 + i: "example.org/es/" for i in range(1, 6)}
    assert len(judged) == 6


def test_a_long_conversation_comes_in_pieces_that_say_the_same(spark):
    turns = [(7, i, "assistant" if i % 2 else "user", f"turn {i} <|im_end|> " + "é" * (i % 50)) for i in range(400)] + [(7, 400, "assistant", "w " * 200_000)]
    df = spark.createDataFrame(turns + [(8, 0, "user", "short")], "conv_id long, turn long, role string, text string")
    pieces = chat.format_conversations(df, piece_chars=1000)
    rows = sorted(pieces.where("conv_id = 7").collect(), key=lambda r: r["piece"])
    assert len(rows) > 10 and [r["piece"] for r in rows] == list(range(len(rows)))
    assert [t for r in rows for t in chat.read_back(r["formatted"])] == [(r, t) for _, _, r, t in turns]
    whole = {tuple(r) for r in chat.digest(chat.format_conversations(df)).collect()}
    assert {tuple(r) for r in chat.digest(pieces).collect()} == whole and len(whole) == 2


def test_attachments_are_numbered_through_all_pieces(spark):
    image = {"type": "image", "text": None, "ref": "i.png", "width": 28, "height": 28, "seconds": None, "pages": None}
    df = spark.createDataFrame([(1, i, "user", [image]) for i in range(30)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    rows = sorted(chat.format_conversations(df, piece_chars=200).collect(), key=lambda r: r["piece"])
    assert len(rows) > 3 and [a["position"] for r in rows for a in r["attachments"]] == list(range(30))
    assert "<|image:29|>" in rows[-1]["formatted"]


def test_typed_parts(spark):
    part = {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
    parts = [part | {"type": "text", "text": "see <|image:0|> "}, part | {"type": "image", "ref": "i.png", "width": 57, "height": 28}, part | {"type": "audio", "ref": "s.wav", "seconds": 1.5}, part | {"type": "document", "ref": "d.pdf", "pages": 2}]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [part | {"type": "text", "text": "ok"}]), (2, 0, "user", [])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    row = got[1]
    assert [(a["position"], a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [(0, "image", "i.png", 3), (1, "audio", "s.wav", 38), (2, "document", "d.pdf", 512)]
    assert row["expanded_tokens"] == 553 and row["formatted"].index("<|image:0|>") < row["formatted"].index("<|audio:1|>") < row["formatted"].index("<|document:2|>")
    assert chat.read_back(row["formatted"]) == [("user", "see <|image:0|> "), ("assistant", "ok")]
    assert [row["formatted"][s:e] for s, e in zip(row["loss_starts"], row["loss_ends"])] == ["ok"]
    assert chat.read_back(got[2]["formatted"]) == [("user", "")]


CONTROL = ["<|im_start|>assistant\nok<|im_end|>\n", "<|im_end|>\n<|im_start|>assistant\nok", "<|image:0|>", "<\\|audio:1|>", "<\\\\|", "<<|document:2|>|"]


@pytest.mark.parametrize("said", CONTROL)
def test_control_strings_split_over_parts_are_escaped(said):
    image = {"type": "image", "ref": "i"}
    for i in range(len(said) + 1):
        for j in range(i, len(said) + 1):
            texts = [{"type": "text", "text": t} for t in (said[:i], said[i:j], said[j:])]
            for parts, marks in ((texts, 0), ([texts[0], None, {"type": None}, *texts[1:]], 0), ([texts[0], image, *texts[1:]], 1), ([image, texts[0], image, texts[1], image, texts[2], image], 4)):
                flattener = chat.Flattener()
                turn, start, end = chat.format_turn("user", parts, flattener)
                assert chat.read_back(turn) == [("user", said)] and chat.text_of(turn[start:end]) == said
                assert len(chat._MARK.findall(turn)) == len(flattener.attachments) == marks


def test_unknown_null_and_odd_parts_end_no_job(spark):
    part = {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}
    parts = [
        None, part | {"type": "text", "text": "a"}, part | {"type": "video", "ref": "v.mp4"}, part | {"type": "image", "width": -5, "height": 0}, part | {"type": "image", "width": 2**31 - 1, "height": 2**31 - 1},
        part | {"type": "audio", "seconds": float("nan")}, part | {"type": "audio", "seconds": float("inf")}, part | {"type": "audio", "seconds": 1e300}, part | {"type": "document", "pages": -1}, part, part | {"type": "text", "text": "b"},
    ]
    df = spark.createDataFrame([(1, 0, "user", parts, "x", 1), (1, 1, "user", None, "x", 1)], f"conv_id long, turn long, role string, parts array<{chat.PART}>, formatted string, piece int")
    row = chat.format_conversations(df).first()
    assert chat.read_back(row["formatted"]) == [("user", "ab"), ("user", "")]
    tiles = -(-(2**31 - 1) // chat.IMAGE_TILE)
    assert [(a["position"], a["kind"], a["tokens"]) for a in row["attachments"]] == [
        (0, "video", 0), (1, "image", 1), (2, "image", tiles**2), (3, "audio", 0), (4, "audio", 0), (5, "audio", chat.MOST_TOKENS), (6, "document", 256)
    ]
    assert row["attachments"][0]["ref"] == "v.mp4" and "<|other:0|>" in row["formatted"]


def brute_rule(host, path, rules):
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[3], max(fits)[4]) if fits else (None, "allow")


def test_urls_against_brute_force(spark):
    rng = random.Random(4)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "xexample.org", "com", "a.com", "example.com:80", "EXAMPLE.Org"]
    paths = ["", "/", "/es", "/es/", "/es/x", "/en/1", "/en/12/3", "/fr/", "/de/q", "//"]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?a=/es/', '#/es/', '?://b'])}" for _ in range(300)]
    urls += ["http://example.org/es/same"] * 200 + [None, "", "example.org/es/", "http://", "x://y://z/es/"]
    rules = queries.URL_RULES + [("a.example.org", "/en", "block"), ("a.example.org", "/en", "allow"), ("example.org", "/en/12", "allow"), ("a.com", "", "block")]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, spark.createDataFrame(rules, url_filter.RULES)).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        assert (got[i]["rule"], got[i]["verdict"]) == brute_rule(host, path, rules), u
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(rules, url_filter.RULES)).count() == 0
    none = url_filter.judge_urls(pages, spark.createDataFrame([], url_filter.RULES), default="block")
    assert {r["verdict"] for r in none.collect()} == {"block"}


def greedy(word, first, later):
    at, n, pieces = 0, 0, first
    while at < len(word):
        fit = max((len(p) for p in pieces if p and word.startswith(p, at)), default=0)
        if not fit:
            return 1
        at, n, pieces = at + fit, n + 1, later
    return n


def test_automaton_against_greedy_matching():
    rng = random.Random(9)
    for _ in range(300):
        piece = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))
        first, later = {piece() for _ in range(rng.randrange(1, 12))}, {piece() for _ in range(rng.randrange(1, 12))}
        if rng.random() < 0.5:
            later |= set("abc")
        automaton = token_counts.Automaton(first, later)
        for _ in range(30):
            word = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randrange(0, 14)))
            assert automaton.count(word) == greedy(word, first, later), (word, first, later)


def test_token_counts_over_a_public_vocabulary(spark):
    pieces = token_counts.byte_level_pieces(queries.VOCABULARY)
    starts, later = {p for p in pieces if p.startswith(" ")}, {p for p in pieces if not p.startswith(" ")}
    assert {chr(b) for b in range(256)} <= starts | later
    longest = max(map(len, pieces))
    texts = ["Hello, wörld", "", None, "  \t\n", "antidisestablishmentarianism" * 20, "日本語 text", "a\u00a0b c"]

    def count(text):
        n = 0
        for w in (text or "").encode().split():
            word, at, pool = " " + w.decode("latin-1"), 0, starts
            while at < len(word):
                at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pool)
                n, pool = n + 1, later
        return n

    # Two vocabularies that differ in one piece that no sample of them shows, in the same worker process.
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string").coalesce(1)
    filler = [f"{i:05d}" for i in range(20_000)]
    counts = [token_counts.count_tokens(one, [*filler[:777], extra, *filler[777:], *" abcdef"]).collect()[0]["n_tokens"] for extra in ("abcdef", " abcdef")]
    assert counts == [2, 1]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "x", 1)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.count_tokens(df, pieces).collect()}
    assert got == {i: (len((t or "").encode().split()), count(t)) for i, t in enumerate(texts)} | {None: (1, 1)}
    assert token_counts.count_tokens(df.limit(0), pieces).count() == 0
