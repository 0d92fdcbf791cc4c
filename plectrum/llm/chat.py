"""Chat formatting: a declarative template, a role automaton and loss-flagged segments.

The template lists the markers, the automaton's legal successors of each role and the roles whose
text is trained on.  :func:`segments` emits one row per text segment (header, body, end of turn) with
its loss flag; it needs one window over (conversation, turn), so a huge conversation is sorted with
spilling, never collected.  :func:`render` joins a conversation's segments into its one formatted text
and keeps their sizes and flags, :func:`parse` reads that text back into turns, and :func:`masked` reads
the flagged segments.

Texts cannot forge a marker: of every control string one character, and the escape character, are
written as two-character codes inside texts, so by default ``#`` and ``<`` occur in markers alone.  The codes follow
from the template's markers and are undone in reverse order; a template that cannot be read back is refused.

Edge cases: null text and null role count as empty; turns sort by turn (null first), then role, then
text, so ties have one order and repeated rows all stay; illegal turn orders are still formatted and
flagged (valid, first_bad_turn); an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    head: str = "### "
    after_role: str = ": "
    end: str = " </turn>\n"
    labels: dict[str, str] = field(
        default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
    )
    #: Marks a role that has no label; its name follows.
    raw_label: str = "@"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Legal successors; "" is the start.
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant",),
        }
    )
    final: tuple[str, ...] = ("assistant",)
    escape_sign: str = "\\"
    #: Codes of the signs that texts, and those that names of roles besides, must not hold; the escape sign's comes first.
    codes: tuple[tuple[str, str], ...] = field(init=False)
    role_codes: tuple[tuple[str, str], ...] = field(init=False)

    def __post_init__(self) -> None:
        shown = list(self.labels.values())
        if not (self.head and self.after_role and self.end and self.raw_label and len(self.escape_sign) == 1):
            raise ValueError("head, after_role, end and raw_label must not be empty and escape_sign is one character")
        if len(set(shown)) < len(shown) or any(x.startswith(self.raw_label) for x in shown):
            raise ValueError("labels must differ and none may begin like raw_label")
        begin = self._sign(self.head, "")
        close = self._sign(self.end, self.head + self.after_role + self.raw_label + "".join(shown))
        after = self._sign(self.after_role, self.raw_label + "".join(shown))
        raw = self._sign(self.raw_label, "")
        told = list(dict.fromkeys([self.escape_sign, begin, close, after, raw]))
        letters = iter(c for c in "shlcabdefgijkmnopqrtuvwxyz" if c not in told)
        codes = [(c, self.escape_sign + next(letters)) for c in told]
        n = len({self.escape_sign, begin, close})
        object.__setattr__(self, "codes", tuple(codes[:n]))
        object.__setattr__(self, "role_codes", tuple(codes[n:]))

    def _sign(self, marker: str, elsewhere: str) -> str:
        """The character of a marker that texts spell as a code: one that no other part of a turn before the marker holds."""
        fit = [c for c in marker if c != self.escape_sign and c not in elsewhere]
        if not fit:
            raise ValueError(f"no character of {marker!r} tells it from the rest of a turn")
        return next((c for c in fit if not (c.isalnum() or c.isspace())), fit[0])

    def escape(self, text: Column) -> Column:
        for plain, code in self.codes:
            text = F.replace(text, F.lit(plain), F.lit(code))
        return text

    def unescape(self, text: Column) -> Column:
        for plain, code in reversed(self.codes):
            text = F.replace(text, F.lit(code), F.lit(plain))
        return text

    def label(self, role: Column) -> Column:
        out = self.escape(role)
        for plain, code in self.role_codes:
            out = F.replace(out, F.lit(plain), F.lit(code))
        out = F.concat(F.lit(self.raw_label), out)
        for name, shown in self.labels.items():
            out = F.when(role == name, F.lit(shown)).otherwise(out)
        return out

    def role_of(self, label: Column) -> Column:
        out = F.substring(label, F.lit(len(self.raw_label) + 1), F.length(label))
        for plain, code in reversed(self.role_codes):
            out = F.replace(out, F.lit(code), F.lit(plain))
        out = self.unescape(out)
        for name, shown in self.labels.items():
            out = F.when(label == shown, F.lit(name)).otherwise(out)
        return out

    def trained(self, role: Column) -> Column:
        """The loss flag of a role's body."""
        return role.isin(*self.loss_roles)

    def legal(self, before: Column, role: Column) -> Column:
        """Whether the automaton steps from state ``before`` (the last role, "" at the start) to role."""
        out = F.lit(False)
        for state, nexts in self.follows.items():
            out = F.when(before == state, role.isin(*nexts)).otherwise(out)
        return out


def _turns(df: DataFrame) -> DataFrame:
    return df.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def segments(df: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, place (0-based turn number), part (0 header, 1 body, 2 end), text, loss, legal."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = _turns(df).select(
        "conv_id",
        (F.row_number().over(order) - 1).cast("long").alias("place"),
        "role",
        "text",
        F.coalesce(F.lag("role").over(order), F.lit("")).alias("before"),
    )
    head = F.concat(F.lit(template.head), template.label(F.col("role")), F.lit(template.after_role))
    parts = F.array(
        F.struct(F.lit(0).alias("part"), head.alias("text"), F.lit(False).alias("loss")),
        F.struct(F.lit(1).alias("part"), template.escape(F.col("text")).alias("text"), template.trained(F.col("role")).alias("loss")),
        F.struct(F.lit(2).alias("part"), F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
    )
    legal = template.legal(F.col("before"), F.col("role"))
    return rows.select("conv_id", "place", legal.alias("legal"), F.inline(parts))


def render(df: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a conversation: formatted text, its segments' sizes and the automaton's verdict.

    A formatted conversation is one string, so its turns meet in one row; nothing else is gathered.
    sizes has, for each turn in order, the loss flag of its body and the code points of its header and
    body in the formatted text; the end marker follows each body.
    """
    turns = _turns(df).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    made = turns.select(
        "conv_id",
        F.transform(
            "t",
            lambda x: F.struct(
                x["role"].alias("role"),
                F.concat(F.lit(template.head), template.label(x["role"]), F.lit(template.after_role)).alias("head"),
                template.escape(x["text"]).alias("body"),
            ),
        ).alias("t"),
    )
    made = made.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(template.end))), "").alias("formatted"),
        F.transform(
            "t",
            lambda x: F.struct(
                template.trained(x["role"]).alias("loss"),
                F.length(x["head"]).alias("head"),
                F.length(x["body"]).alias("body"),
            ),
        ).alias("sizes"),
        F.filter(
            F.transform(
                "t",
                lambda x, i: F.when(
                    ~template.legal(F.when(i == 0, F.lit("")).otherwise(F.get(F.col("t"), i - 1)["role"]), x["role"]), i
                ),
            ),
            lambda i: i.isNotNull(),
        ).alias("bad"),
        F.element_at("t", -1)["role"].isin(*template.final).alias("ends_well"),
    )
    first_bad = F.get("bad", F.lit(0))
    return made.select(
        "conv_id", "formatted", "sizes", (first_bad.isNull() & F.col("ends_well")).alias("valid"), first_bad.cast("long").alias("first_bad_turn")
    )


def _pieces(template: Template) -> Column:
    """The turns of the formatted text, without their end markers."""
    pieces = F.split("formatted", "".join(f"\\x{{{ord(c):x}}}" for c in template.end))
    return F.slice(pieces, F.lit(1), F.size(pieces) - 1)


def masked(template: Template = Template()) -> Column:
    """The texts in the flagged segments of a rendered row, null for a turn without: array<string>."""

    def body(piece: Column, size: Column) -> Column:
        return F.when(size["loss"], template.unescape(F.substring(piece, size["head"] + 1, size["body"])))

    return F.zip_with(_pieces(template), F.col("sizes"), body)


def parse(rendered: DataFrame, *keep: str, template: Template = Template()) -> DataFrame:
    """Reads the formatted text alone back into turns: array<struct<role, text>>."""

    def turn(piece: Column) -> Column:
        label = F.substring_index(F.substring(piece, len(template.head) + 1, 2_000_000_000), template.after_role, 1)
        body = F.substring(piece, F.lit(len(template.head) + len(template.after_role) + 1) + F.length(label), F.length(piece))
        return F.struct(template.role_of(label).alias("role"), template.unescape(body).alias("text"))

    return rendered.select("conv_id", *keep, "formatted", F.transform(_pieces(template), turn).alias("turns"))


#: The conversation that the contract adds: both texts hold markers and the escape character.
PROBE = "\\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return digests(render(conversations.unionByName(probe)))


def digests(rendered: DataFrame) -> DataFrame:
    """Counts and digests of what is read back: the turns from the text alone, the loss from the flagged segments."""
    back = parse(rendered, "sizes", "valid", "first_bad_turn")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(masked(), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "first_bad_turn",
    )
