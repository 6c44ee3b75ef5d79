"""Quotation linking: parsing cases, and links against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def norm(x):
    return re.sub(r"\s+", " ", x.lower()).strip(" ")


def plain_parse(text):
    """Own text, and (level, lines) of the quoted passages and own passages."""
    passages = []
    for line in re.split(r"\r\n|\r|\n", text or ""):
        signs = re.match(r"(?:[ \t]*>)+", line)
        level = signs[0].count(">") if signs else 0
        body = re.sub(r"^(?:[ \t]*>)+ ?", "", line)
        if passages and passages[-1][0] == level:
            passages[-1][1].append(body)
        else:
            passages.append((level, [body]))
    for k, (level, lines) in enumerate(passages):
        if level == 0 and k + 1 < len(passages) and re.match(chat.ATTRIBUTION, lines[-1].lower()):
            lines.pop()
    quotes = [p for p in passages if p[0]]
    own = [p for p in passages if not p[0]]
    words = re.sub(r"^\s+|\s+\Z", "", "\n".join(x for _, ls in own for x in ls)) if quotes else text or ""
    return words, quotes, own


def units(passages):
    return {(level, u) for level, lines in passages for u in [norm(" ".join(lines)), *map(norm, lines)] if u}


def plain_link(rows):
    parsed = {}
    for conv, turn, _, text in rows:
        words, quotes, own = plain_parse(text)
        mine = {u for _, u in units(own)} | ({norm(words)} - {""})
        old = parsed.setdefault((conv, turn), (set(), set()))
        parsed[conv, turn] = (old[0] | units(quotes), old[1] | mine)
    reply, linked = {}, {}
    for (conv, turn), (quoted, _) in parsed.items():
        if conv is None or turn is None:
            continue
        votes = {}
        for level, unit in quoted:
            earlier = [t for (c, t), (_, mine) in parsed.items() if c == conv and t is not None and t < turn and unit in mine]
            if earlier:
                key = (level, max(earlier))
                votes[key] = votes.get(key, 0) + len(unit)
                linked[conv, turn] = linked.get((conv, turn), 0) + 1
        if votes:
            reply[conv, turn] = -min((level, -chars, -source) for (level, source), chars in votes.items())[2]
    out = []
    for conv, turn, role, text in rows:
        root = turn
        while (conv, root) in reply:
            root = reply[conv, root]
        words, quotes, _ = plain_parse(text)
        out.append((str(conv), str(turn), role, words, len(quotes), linked.get((conv, turn), 0), str(reply.get((conv, turn))), str(root)))
    return sorted(out, key=str)


def result(df):
    return sorted(((str(r.conv_id), str(r.turn), r.role, r.text, r.n_quotes, r.n_linked, str(r.reply_to), str(r.thread)) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    word = lambda: rng.choice(["Alpha", "beta", "gamma", "DELTA", "é", "ok", "thanks"])
    made = []
    for conv in range(6):
        said = []
        for turn in range(0, 60, rng.choice([1, 3])):
            lines = [" ".join(word() for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 3))]
            if said and rng.random() < 0.7:
                for _ in range(rng.randint(1, 2)):
                    old = rng.choice(said).split("\n")
                    part = old if rng.random() < 0.6 else [rng.choice(old)]
                    signs = rng.choice(["> ", ">", " > "])
                    quoted = [signs + x.upper() for x in part]
                    at = rng.randint(0, len(lines))
                    lines[at:at] = (["On Monday somebody wrote:"] if rng.random() < 0.3 else []) + quoted
            text = "\n".join(lines)
            said.append(text)
            made.append((conv, turn, rng.choice(["user", "assistant", None]), text))
    made += [(9, 0, "user", None), (9, 1, "user", ""), (9, 2, "user", ">>> deep\r\n> never said\r\nown"), (None, 1, "x", "> a"), (9, None, "x", "a"), made[3], made[3]]
    made += [(10, t, "user", "thanks" if t % 2 else "> thanks\nthanks") for t in range(40)] + [(11, 0, "u", "long\n" * 3000), (11, 1, "u", "> " + "long " * 3000)]
    return made


@pytest.mark.parametrize("width", [4, 1024])
def test_links_equal_brute_force(spark, rows, monkeypatch, width):
    monkeypatch.setattr(chat, "RANGE", width)
    assert result(chat.link(spark.createDataFrame(rows, SCHEMA))) == plain_link(rows)


def test_replies_follow_what_they_reply_to(spark, rows):
    place = {}
    for k, r in enumerate(chat.link(spark.createDataFrame(rows, SCHEMA)).collect()):
        place.setdefault((r.conv_id, r.turn), (k, r.reply_to))
    assert all(place[conv, reply][0] < k for (conv, _), (k, reply) in place.items() if reply is not None)


def test_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi", 7), (1, 1, "assistant", "> hi\nhello", 8)], SCHEMA + ", source int")
    got = chat.link(df).collect()
    assert [(r.text, r.reply_to, r.source, r.formatted) for r in got] == [("hi", None, 7, "<|user|>\nhi"), ("hello", 0, 8, "<|assistant|>\nhello")]
    assert chat.link(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.link(df.withColumn("thread", F.lit(1)))
