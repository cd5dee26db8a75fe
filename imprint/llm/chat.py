"""Chat formatting: turns in order through a finite-state machine, as text segments with loss flags.

A ``Template`` says, as plain data, what stands before and after a text for every
expected (state, role), whether the text counts in the loss, and which state
follows. A turn that the state does not expect is written in the spare form, which
names its role, and makes the conversation irregular; nothing is left out.

Control strings inside texts get one backslash more after their first character
than they have, and lose it again when read, so the formatted text has control
strings only where the template put them, and texts come back exactly.

A conversation is cut into chunks of consecutive turn numbers, which are formatted
apart from each other. A chunk needs the state that the chunks before leave behind.
Over a chunk the machine is a map from states to states, and maps compose; so one
narrow pass over the roles finds the entry states, without any text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A chunk has 2 to this power turn numbers.
SPAN_BITS = 6


@dataclass(frozen=True)
class Rule:
    """What a turn becomes: ``before`` text ``after``; the next state; whether the text is learned."""

    state: str
    role: str
    before: str
    after: str
    to: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Rules of a format. The first state is where a conversation starts, ``final`` where it may end.

    ``spare`` is (before the role, between role and text, after the text) of turns
    without a rule; ``learned`` roles count in the loss there too. After such a turn
    the machine is in the state that the role's rules lead to, or stays.
    """

    states: tuple[str, ...]
    rules: tuple[Rule, ...]
    controls: tuple[str, ...]
    spare: tuple[str, str, str]
    final: tuple[str, ...]

    def __post_init__(self):
        c = sorted({x[0] + y[1:] for x in self.controls for y in self.controls})  # what ``control_pattern`` takes for one
        if any(len(x) < 2 or "\\" in x for x in c):
            raise ValueError("control strings have two characters or more and no backslash")
        meets = lambda x, y: x.startswith(y) or y.startswith(x)
        if any(x is not y and meets(x, y) for x in c for y in c):
            raise ValueError("a control string begins another")
        pieces = [p for r in self.rules for p in (r.before, r.after)] + list(self.spare)
        for x in c:
            for k in range(1, len(x)):
                if any(meets(x[k:], y) for y in c):
                    raise ValueError(f"{x!r} overlaps a control string")
                if any(p and (meets(x[k:], p) or p.endswith(x[:k])) for p in pieces):
                    raise ValueError(f"{x!r} can arise where a text meets the template")
        ends = [r.after for r in self.rules] + list(self.spare[1:])
        if not all(any(x in p for x in c) for p in ends):
            raise ValueError("what ends a text holds a control string")
        starts = sorted({r.before for r in self.rules} | {self.spare[0]})
        if any(meets(x, y) for x in starts for y in starts if x != y):
            raise ValueError("the beginning of one turn begins that of another")
        if len({(r.before, r.after, r.role) for r in self.rules}) != len({r.before for r in self.rules}):
            raise ValueError("the beginning of a turn tells its role and end")
        if len({(r.state, r.role) for r in self.rules}) != len(self.rules):
            raise ValueError("one rule for each state and role")

    @property
    def roles(self) -> list[str]:
        return sorted({r.role for r in self.rules})

    def learns(self, role: str) -> bool:
        return any(r.loss for r in self.rules if r.role == role)

    def step(self, state: str, role: str | None) -> tuple[str, Rule | None]:
        """Next state, and the rule of this turn or None."""
        found = next((r for r in self.rules if (r.state, r.role) == (state, role)), None)
        if found:
            return found.to, found
        return next((r.to for r in self.rules if r.role == role), state), None


#: Instructions in brackets, answers closed by an end mark.
INSTRUCT = Template(
    states=("start", "system", "user", "assistant"),
    rules=(
        Rule("start", "system", "<<SYS>>\n", "\n<</SYS>>\n", "system"),
        Rule("start", "user", "<s>[INST] ", " [/INST]", "user"),
        Rule("system", "user", "<s>[INST] ", " [/INST]", "user"),
        Rule("assistant", "user", "<s>[INST] ", " [/INST]", "user"),
        Rule("user", "assistant", " ", "</s>", "assistant", loss=True),
    ),
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"),
    spare=("[ROLE]", "[/ROLE] ", "</s>"),
    final=("assistant",),
)


def _quoted(text: str) -> str:
    """``text`` as a pattern of Java and of the usual SQL engines."""
    return re.sub(r"([^A-Za-z0-9 \n])", r"\\\1", text).replace("\n", r"\n")


def control_pattern(template: Template) -> str:
    """Groups of a control string with any number of backslashes: first character, backslashes, the rest."""
    by_first: dict[str, list[str]] = {}
    for c in template.controls:
        by_first.setdefault(c[0], []).append(_quoted(c[1:]))
    heads = "".join(map(_quoted, by_first))
    rests = "|".join(sorted({r for rests in by_first.values() for r in rests}))
    return rf"([{heads}])(\\*)({rests})"


def escape(text: Column, template: Template = INSTRUCT) -> Column:
    """``text`` without control strings."""
    return F.regexp_replace(text, control_pattern(template), r"$1$2\\$3")


def unescape(text: Column, template: Template = INSTRUCT) -> Column:
    """What was escaped."""
    head, slashes, rest = re.fullmatch(r"(\(\[.*?\]\))(\(\\\\\*\))(.*)", control_pattern(template), re.S).groups()
    return F.regexp_replace(text, rf"{head}{slashes}\\{rest}", "$1$2$3")


def _number(values: list[str], value: Column) -> Column:
    """Place of ``value`` in a short list; the length of the list for others and for null."""
    return reduce(lambda rest, x: F.when(value == x[1], x[0]).otherwise(rest), reversed(list(enumerate(values))), F.lit(len(values)))


def _pick(options: list, at: Column) -> Column:
    """An entry of a constant list."""
    return F.element_at(F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options]), at + 1)


def _table(template: Template, value) -> list:
    """``value(next state, rule or None, role or None)`` of every state and role number, in one list."""
    roles = [*template.roles, None]
    return [value(*template.step(s, r), r) for s in template.states for r in roles]


def _keyed(rows: DataFrame, conv_col: str, turn_col: str, role_col: str) -> DataFrame:
    """Adds what chunks are told apart by; null ids and null turns are keys like others."""
    kind = dict(rows.dtypes)[conv_col]
    nothing = F.lit("" if kind == "string" else 0).cast(kind)
    turn = F.col(turn_col).cast("bigint")
    return rows.select(
        F.coalesce(conv_col, nothing).alias("conv"), F.col(conv_col).isNull().alias("nameless"),
        F.coalesce(F.shiftright(turn, SPAN_BITS), F.lit(-(2**62))).alias("chunk"),
        turn.alias("turn"), F.col(role_col).alias("role"),
        *[c for c in rows.columns if c not in (conv_col, turn_col, role_col)],
    )


_KEY = ["conv", "nameless", "chunk"]


def entry_states(keyed: DataFrame, template: Template) -> DataFrame:
    """conv, nameless, chunk, entry (state number) of all chunks of conversations with several chunks."""
    n, width = len(template.states), len(template.roles) + 1
    steps = F.array(*[F.lit(template.states.index(s)) for s in _table(template, lambda to, rule, role: to)])
    code = _number(template.roles, F.col("role"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", code.alias("code"))))
    start = F.array(*[F.lit(k) for k in range(n)])
    over = F.aggregate("turns", start, lambda states, t: F.transform(states, lambda s: F.element_at(steps, s * width + t["code"] + 1)))
    maps = keyed.select(*_KEY, "turn", "role").groupBy(*_KEY).agg(ordered.alias("turns")).select(*_KEY, over.alias("map"))
    # A conversation of many chunks is one row here, with a few bytes for 64 turn numbers.
    chains = maps.groupBy("conv", "nameless").agg(F.array_sort(F.collect_list(F.struct("chunk", "map"))).alias("chain")).filter(F.size("chain") > 1)
    into = F.aggregate(
        "chain", F.array(F.lit(0)),
        lambda states, x: F.concat(states, F.array(F.element_at(x["map"], F.element_at(states, -1) + 1))),
    )
    return (
        chains.select("conv", "nameless", F.explode(F.arrays_zip(F.col("chain.chunk").alias("chunk"), F.slice(into, 1, F.size("chain")).alias("entry"))).alias("x"))
        .select("conv", "nameless", "x.chunk", "x.entry")
    )


def format_chunks(
    conversations: DataFrame,
    template: Template = INSTRUCT,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv_id, chunk, alone, n_turns, n_irregular, last_state, segments of every run of turns.

    ``segments`` are (text, loss) in order; all segments of a conversation's chunks,
    by ``chunk``, are its formatted text. Turns stand by (turn, role, text), nulls
    first. Null text is empty. A null or unknown role takes the spare form; a null
    role is written as the empty one. Repeated rows are repeated turns. Rows with a
    null conv_id are one conversation. ``alone`` says that the conversation has no
    other chunk. An empty table gives an empty one; other columns are ignored.

    Texts are shuffled once, by chunk, so a long conversation is spread over tasks.
    """
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    )
    keyed = _keyed(rows, "conv_id", "turn", "role")
    entries = entry_states(keyed, template)
    width, none = len(template.roles) + 1, len(template.roles)
    steps = [template.states.index(s) for s in _table(template, lambda to, rule, role: to)]
    grouped = keyed.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    joined = grouped.join(entries, _KEY, "left").select(
        *_KEY, "turns", F.col("entry").isNull().alias("alone"), F.coalesce("entry", F.lit(0)).alias("entry"),
        F.transform("turns", lambda t: _number(template.roles, t["role"])).alias("codes"),
    )
    states = F.aggregate("codes", F.array("entry"), lambda s, c: F.concat(s, F.array(_pick(steps, F.element_at(s, -1) * width + c))))
    walked = joined.withColumn("states", states)
    unexpected = F.array(*[F.lit(r is None) for r in _table(template, lambda to, rule, role: rule)])
    at = F.zip_with(F.slice("states", 1, F.size("codes")), "codes", lambda s, c: s * width + c)
    walked = walked.select(
        "conv", "nameless", "chunk", "alone", "turns", at.alias("at"), F.element_at("states", -1).alias("last"),
    )
    before = _table(template, lambda to, rule, role: rule.before if rule else None)
    after = _table(template, lambda to, rule, role: rule.after if rule else template.spare[2])
    loss = _table(template, lambda to, rule, role: rule.loss if rule else role is not None and template.learns(role))

    def segment(text: Column, flag) -> Column:
        return F.struct(text.alias("text"), (F.lit(flag) if isinstance(flag, bool) else flag).alias("loss"))

    def write(t: Column, k: Column) -> Column:
        spare = F.concat(F.lit(template.spare[0]), escape(F.coalesce(t["role"], F.lit("")), template), F.lit(template.spare[1]))
        head = F.coalesce(_pick([F.lit(b) for b in before], k), spare)
        return F.array(segment(head, False), segment(escape(t["text"], template), _pick(loss, k)), segment(_pick(after, k), False))

    return walked.select(
        F.when(~F.col("nameless"), F.col("conv")).alias("conv_id"), "chunk", "alone",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.size(F.filter("at", lambda k: F.element_at(unexpected, k + 1))).cast("bigint").alias("n_irregular"),
        _pick(list(template.states), F.col("last")).alias("last_state"),
        F.flatten(F.zip_with("turns", "at", write)).alias("segments"),
    )


def formatted(segments: Column) -> Column:
    """The formatted text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def learned(segments: Column, template: Template = INSTRUCT) -> Column:
    """The texts under the loss mask, as they were, without anything between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")


def read_turns(text: Column, template: Template = INSTRUCT) -> Column:
    """The turns (role, text) that a formatted text or chunk was made from, in order."""
    kinds = sorted({(r.before, r.after, r.role) for r in template.rules})
    a, b, c = map(_quoted, template.spare)
    forms = [rf"{_quoted(x)}.*?{_quoted(y)}" for x, y, _ in kinds] + [f"{a}.*?{b}.*?{c}"]

    def inner(turn: Column, x: str, y: str) -> Column:
        return turn.substr(F.lit(len(x) + 1), F.length(turn) - len(x) - len(y))

    def read(turn: Column) -> Column:
        rest = inner(turn, template.spare[0], template.spare[2])
        cut = F.instr(rest, template.spare[1])
        role = unescape(rest.substr(F.lit(1), cut - 1), template)
        body = rest.substr(cut + len(template.spare[1]), F.length(rest))
        for x, y, name in kinds:
            known = turn.startswith(x)
            role = F.when(known, F.lit(name)).otherwise(role)
            body = F.when(known, inner(turn, x, y)).otherwise(body)
        return F.struct(role.alias("role"), unescape(body, template).alias("text"))

    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s){'|'.join(forms)}"), F.lit(0)), read)
