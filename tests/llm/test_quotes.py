import re

from pyspark.sql import functions as F

from spindle.llm.queries import QUERIES
from spindle.llm.quotes import linked_messages
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"


def norm(text):
    return re.sub(r"\s+", " ", text.lower()).strip(" ")


def cut(text):
    found = {norm(text)} | {norm(p) for p in re.split(r"\n\s*\n", text)} | {norm(x) for x in text.split("\n")}
    return found - {""}


def runs(text):
    out = []
    for line in re.split(r"\r?\n", text or ""):
        marks = re.match(r"(?:[ \t]*>)*", line)[0]
        level = marks.count(">")
        if level:
            line = re.sub(r"^(?:[ \t]*>)+ ?", "", line)
        if out and out[-1][0] == level:
            out[-1][1].append(line)
        else:
            out.append((level, [line]))
    return [(level, "\n".join(lines)) for level, lines in out]


def slow(rows):
    parsed, said = [], {}
    for conv, turn, role, text in rows:
        parts = runs(text)
        body = re.sub(r"^\s+|\s+$", "", "\n".join(t for level, t in parts if level == 0))
        parsed.append((conv, turn, role, parts, body))
        if conv is not None and turn is not None:
            for unit in set().union(cut(body), *[cut(t) for level, t in parts if level == 0]):
                said[conv, unit] = min(turn, said.get((conv, unit), turn))
    parent = {}
    for conv, turn, _, parts, _ in parsed:
        for level, text in parts:
            for unit in cut(text) if level and turn is not None else ():
                if said.get((conv, unit), turn) < turn:
                    key = (-level, len(unit), said[conv, unit])
                    parent[conv, turn] = max(key, parent.get((conv, turn), key))
    out = []
    for conv, turn, role, parts, body in parsed:
        up, depth = turn, 0
        while (conv, up) in parent:
            up, depth = parent[conv, up][2], depth + 1
        direct = parent.get((conv, turn), (0, 0, None))[2]
        out.append((conv, turn, role, sum(level > 0 for level, _ in parts), direct, up, depth, body, f"<|{role or 'user'}|>\n{body}\n"))
    return sorted(out, key=repr)


ROWS = [
    (1, 0, "user", "How do I  sort\na table?\n\nThanks in advance."),
    (1, 1, "assistant", "> How do I sort\n> a table?\nUse order by.\nIt sorts."),
    (1, 2, "user", ">> how do i sort a table?\n> Use ORDER BY.\n\nThat worked, é too."),
    (1, 3, "user", "> > Thanks in advance.\nno level one here"),
    (1, 4, "assistant", "> said by nobody\n>>> That worked, é too.\n>It sorts.\r\nok"),
    (1, 5, None, "> ok\nfine > not a quote"),
    (1, 6, "user", "> fine > not a quote\n> ok"),
    (2, 0, "user", "> Use order by.\nother conversation"),
    (2, 1, "user", None),
    (2, 2, "user", ""),
    (2, 3, "user", ">\n> \n>>"),
    (2, 3, "user", "> other conversation\nsame place"),
    (None, 4, "user", "> other conversation\nno conversation"),
    (2, None, "user", "> other conversation\nno turn"),
    (3, 9, "user", "> later text\nearly"),
    (3, 10, "user", "later text"),
]


def test_links_against_brute_force(spark):
    rows = ROWS + [(7, i, "user", f"> message {i - 1}\nmessage {i}" if i else "message 0") for i in range(40)] + [(8, 0, "user", "hot")]
    rows += [(8, i, "user", "> hot\nme too") for i in range(1, 60)] + [(9, 0, "user", "word " * 60_000), (9, 1, "user", "> " + "word " * 60_000)]
    messages = spark.createDataFrame(rows, SCHEMA).withColumn("hash", F.lit(1)).withColumn("level", F.lit("x")).repartition(3)
    got = linked_messages(messages)
    assert sorted(map(tuple, got.collect()), key=repr) == slow(rows)
    deep = {(r["conv_id"], r["turn"]): r for r in got.collect()}
    assert deep[7, 39]["depth"] == 39 and deep[7, 39]["thread_turn"] == 0 and deep[1, 2]["parent_turn"] == 1 and deep[3, 9]["parent_turn"] is None
    assert linked_messages(messages.limit(0)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op4_chat_quotes"](spark, SF).collect()), key=repr) == slow(rows)
