"""Chat formatting by schema fingerprinting.

A record is one JSON object in any of several layouts (messages, from/value lists, prompt and response,
instruction and output). Its fingerprint is the hash of those of its nested field paths that any mapping names; the
fingerprint selects a declarative mapping that reads its turns. Canonical turns (role, text) are then set into the chat template
and the assistant texts' places are returned as loss mask. DataFrame functions only.

Template: user ``<s>[INST] text [/INST]``, assistant `` text</s>``, system ``[SYS] text [/SYS]``, any other
role ``[ROLE name] text [/ROLE]``. Inside texts ``&``, ``<`` and ``[`` are written ``&amp;``, ``&lt;`` and
``&#91;`` (in role names ``]`` too, as ``&#93;``), so no text can hold a control string and all can be read back.

Edge cases: null texts and roles are empty; turns of one number are ordered by role and text; a conversation
whose id is null is one of its own; a record of no known layout, and one that is no JSON object, has no turns; fields that no mapping names
(``name``, ``id``, ``metadata``) don't matter; a text that is no JSON string is taken as its JSON text; columns of the records named ``layout`` or ``turns``
give way to the operator's own; repeated rows are turns of their own; an empty table gives no rows. A conversation is one value of a row, and so bounded by
Spark's limits for a string and a variant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURNS = "array<struct<role:string,text:string>>"
FIELDS = ("messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, "
          "prompt string, response string, system string, instruction string, input string, output string")
SENDER_ROLES = {"human": "user", "gpt": "assistant"}


def _turn(role: str, column: str):
    return F.array(F.struct(F.lit(role).alias("role"), F.coalesce(F.col(f"r.{column}"), F.lit("")).alias("text")))


def _senders(name):
    out = name
    for sender, role in SENDER_ROLES.items():
        out = F.when(name == sender, F.lit(role)).otherwise(out)
    return out


def _blank(x):
    return F.coalesce(x, F.lit(""))


# layout -> (its field paths, its turns)
MAPPINGS = {
    "messages": (["messages", "messages[].content", "messages[].role"], lambda: F.transform(
        "r.messages", lambda m: F.struct(_blank(m["role"]).alias("role"), _blank(m["content"]).alias("text")))),
    "senders": (["conversations", "conversations[].from", "conversations[].value"], lambda: F.transform(
        "r.conversations", lambda m: F.struct(_senders(_blank(m["from"])).alias("role"), _blank(m["value"]).alias("text")))),
    "prompt": (["prompt", "response"], lambda: F.concat(_turn("user", "prompt"), _turn("assistant", "response"))),
    "instruction": (["instruction", "output", "system"], lambda: F.concat(
        _turn("system", "system"), _turn("user", "instruction"), _turn("assistant", "output"))),
    "instruction-input": (["input", "instruction", "output"], lambda: F.concat(
        F.array(F.struct(F.lit("user").alias("role"), F.concat(_blank(F.col("r.instruction")), F.when(
            _blank(F.col("r.input")) != "", F.concat(F.lit("\n\n"), F.col("r.input"))).otherwise("")).alias("text"))), _turn("assistant", "output"))),
}


KNOWN_PATHS = sorted({path for shape, _ in MAPPINGS.values() for path in shape})
LISTS = sorted({path.split("[]")[0] for path in KNOWN_PATHS if "[]" in path})


def paths(record):
    """The nested field paths of a JSON record that mappings name, sorted; null for a text that is no JSON object."""
    fields = F.from_json(record, "map<string,string>")

    def inside(name):
        items = F.from_json(F.try_element_at(fields, F.lit(name)), "array<map<string,string>>")
        keys = F.flatten(F.transform(F.filter(items, lambda m: m.isNotNull()), F.map_keys))
        return F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.concat(F.lit(f"{name}[]."), k))
    every = F.concat(F.map_keys(fields), *[inside(name) for name in LISTS])
    return F.array_sort(F.array_distinct(F.filter(every, lambda path: path.isin(*KNOWN_PATHS))))


def fingerprint(record):
    return F.xxhash64(F.array_join(paths(record), "\n"))


def canonical_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """The records' other columns, ``layout`` (null: unknown) and ``turns``, an array of (role, text)."""
    keep = [c for c in records.columns if c.lower() not in (record.lower(), "layout", "turns")]
    read = records.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), fingerprint(F.col(record)).alias("f"),
                          F.from_json(record, FIELDS).alias("r"))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for name, (shape, make) in MAPPINGS.items():
        chosen = F.col("f") == F.xxhash64(F.lit("\n".join(sorted(shape))))
        layout = F.when(chosen, F.lit(name)).otherwise(layout)
        turns = F.when(chosen, make().cast(TURNS)).otherwise(turns)
    return read.select("row.*", layout.alias("layout"), turns.alias("turns"))


def _replaced(text, pairs):
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]
ROLE_ESCAPES = [*ESCAPES, ("]", "&#93;")]
TURN = r"<s>\[INST\] [^<\[]* \[/INST\]|\[SYS\] [^<\[]* \[/SYS\]|\[ROLE [^<\[\]]*\] [^<\[]* \[/ROLE\]| [^<\[]*</s>"


def escape(text, pairs=ESCAPES):
    return _replaced(text, pairs)


def unescape(text, pairs=ESCAPES):
    return _replaced(text, [(b, a) for a, b in reversed(pairs)])


def _parts(role, text):
    """(what stands before the text, the text as written, what stands after it)."""
    before = (F.when(role == "user", F.lit("<s>[INST] ")).when(role == "assistant", F.lit(" ")).when(role == "system", F.lit("[SYS] "))
              .otherwise(F.concat(F.lit("[ROLE "), escape(role, ROLE_ESCAPES), F.lit("] "))))
    after = (F.when(role == "user", F.lit(" [/INST]")).when(role == "assistant", F.lit("</s>")).when(role == "system", F.lit(" [/SYS]"))
             .otherwise(F.lit(" [/ROLE]")))
    return before, escape(text), after


def formatted(turns: DataFrame, key: str) -> DataFrame:
    """(key, formatted, loss): the template's text of every row and the places (start, length; code points) of
    its assistant texts. ``key`` names rows uniquely; ``turns`` is their array of (role, text)."""
    each = turns.select(F.col(key), F.posexplode_outer("turns").alias("pos", "t"))
    before, text, after = _parts(F.col("t.role"), F.col("t.text"))
    each = each.select(key, "pos", (F.col("t.role") == "assistant").alias("loss"), before.alias("a"), text.alias("b"), after.alias("c"))
    size = F.char_length("a") + F.char_length("b") + F.char_length("c")
    so_far = F.sum(size).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    each = each.select(key, F.struct("pos", F.concat("a", "b", "c").alias("piece"), "loss",
                                     (F.coalesce(so_far, F.lit(0)) + F.char_length("a")).cast("int").alias("start"),
                                     F.char_length("b").alias("length")).alias("p"))
    rows = each.groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("p"))
    loss = F.transform(F.filter("p", lambda x: F.coalesce(x["loss"], F.lit(False))), lambda x: F.struct(x["start"], x["length"]))
    return rows.select(key, F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), loss.alias("loss"))


def read_back(text):
    """The turns (role, text) of a formatted text."""
    pieces = F.regexp_extract_all(text, F.lit(TURN), 0)

    def one(x):
        name = F.regexp_extract(x, r"^\[ROLE ([^<\[\]]*)\] ", 1)
        role = (F.when(F.startswith(x, F.lit("<s>")), F.lit("user")).when(F.startswith(x, F.lit(" ")), F.lit("assistant"))
                .when(F.startswith(x, F.lit("[SYS] ")), F.lit("system")).otherwise(unescape(name, ROLE_ESCAPES)))
        body = F.regexp_replace(x, r"^(?:<s>\[INST\] |\[SYS\] |\[ROLE [^<\[\]]*\] | )|(?: \[/INST\]| \[/SYS\]| \[/ROLE\]|</s>)$", "")
        return F.struct(role.alias("role"), unescape(body).alias("text"))
    return F.transform(pieces, one)


def records_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, record): the conversations (rows by turn) as JSON records in the layout that fits them: prompt and
    response, instruction and output, from/value lists (odd ids) or messages."""
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(
        F.col("turn").cast("bigint").alias("turn"), _blank(F.col("role").cast("string")).alias("role"),
        _blank(F.col("text").cast("string")).alias("text")).alias("t"))
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: x["role"]), ",")

    def text(i):
        return F.get("t", i)["text"]

    def sender(role):
        return F.when(role == "user", F.lit("human")).when(role == "assistant", F.lit("gpt")).otherwise(role)

    plain = ~F.exists("t", lambda x: x["role"].isin(*SENDER_ROLES))
    record = (F.when(roles == "user,assistant", F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
              .when(roles == "system,user,assistant", F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))))
              .when(plain & (F.col("conv_id") % 2 != 0), F.to_json(F.struct(F.transform("t", lambda x: F.struct(
                  sender(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations"))))
              .otherwise(F.to_json(F.struct(F.transform("t", lambda x: F.struct(
                  x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))))
    return conv.select("conv_id", record.alias("record"))


def report(turns: DataFrame) -> DataFrame:
    """Formatted conversations, read back: counts and digests of the turns and of the text under the loss mask."""
    f = formatted(turns, "conv_id").withColumn("back", read_back(F.col("formatted")))
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return f.withColumn("learned", learned).select(
        "conv_id", F.size("back").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"))
