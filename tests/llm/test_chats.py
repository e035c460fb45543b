"""The template language, and conversations formatted and read back."""

from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import chats
from corvane.llm.templates import FILTERS, Template, TemplateError, folded_blocks, parsed

MESSAGES = [{"role": "system", "text": " be kind "}, {"role": "user", "text": "hi"}, {"role": "assistant", "text": "hello"}]


def put(source, **given):
    return Template(source).render(**given)[0]


@pytest.mark.parametrize(("source", "want"), [
    ("a{{ 'b' }}c", "abc"),
    ("{{ 1 + 2 - 4 }}{{ -3 }}{{ 7 % 4 }}", "-1-33"),
    ("{{ 'a' ~ 1 ~ true ~ none }}", "a1true"),
    ("{{ 1 if 2 > 1 else 3 }}{{ 4 if false }}", "1"),
    ("{{ 'x' in 'axb' and not 'y' in 'axb' }}", "true"),
    ("{{ ('a' or 'b') ~ ('' or 'c') }}", "ac"),
    ("{{ ' x ' | trim | upper }}", "X"),
    ("{% for m in messages %}{{ loop.index }}{{ m.role }}{% if not loop.last %}, {% endif %}{% endfor %}", "1system, 2user, 3assistant"),
    ("{% for m in none %}x{% else %}empty{% endfor %}", "empty"),
    ("{% for m in messages %}{% for k in messages %}{{ k.role[0] if false else loop.index0 }}{% endfor %}{{ loop.first }}{% endfor %}", "012true012false012false"),
    ("{% set n = 'a' %}{{ n }}{% if n == 'b' %}1{% elif n == 'a' %}2{% else %}3{% endif %}", "a2"),
    ("a  {%- if true -%}  b  {%- endif -%}  c", "abc"),
    ("{# a note #}x{{ messages[0]['text'] | trim }}{{ messages[9].text }}", "xbe kind"),
    ("{{ messages | length }}{{ \"q'\\n\" }}", "3q'\n"),
    ("{{ unknown.field }}|{{ m }}", "|"),
])
def test_what_templates_put(source, want):
    assert put(source, messages=MESSAGES) == want


@pytest.mark.parametrize("source", [
    "{{ ''.__class__.__mro__ }}", "{{ messages.append }}", "{{ 'a'.upper() }}", "{{ x | eval }}", "{% import os %}", "{{ f(1) }}", "{% for i in 'abc' %}{% endfor %}", "{{ [1] }}",
    "{{ a", "{% if a %}", "{% endfor %}", "{{ 1 1 }}", "{{ }}", "{{ 'a' + 1 }}", "{{ messages }}", "{% for if in x %}{% endfor %}", "{{ 1 % 0 }}", "{{ a %}", "{% generation x %}{% endgeneration %}",
    "{{ " + "(" * 99 + "1" + ")" * 99 + " }}", "{% if a %}" * 99 + "{% endif %}" * 99, "{{ 2 * 9 }}", "{{ 9 ** 9 }}",
])
def test_what_templates_cannot(source):
    with pytest.raises(TemplateError):
        put(source, messages=MESSAGES, x="x")


def test_constants_are_folded():
    tree = folded_blocks(parsed("a{{ 'b' | upper }}{% if 1 == 2 %}x{% else %}{{ 1 + 1 }}{% endif %}{{ m ~ ('c' ~ 'd') }}{% if true and m %}{{ 'e' }}f{% endif %}"), FILTERS)
    assert tree == [("text", "aB2"), ("put", ("op", "~", ("name", "m"), ("const", "cd"))), ("if", [(("name", "m"), [("text", "ef")])], [])]


def test_spans_and_pieces():
    t = Template("<{% for m in messages %}{{ m.role }}:{% if m.role == 'assistant' %}{% generation %}{{ m.text }}{% generation %}!{% endgeneration %}{% endgeneration %}{% endif %};{% endfor %}>")
    text, spans = t.render(messages=MESSAGES)
    assert [text[a:b] for a, b in spans] == ["hello!"]
    pieces = [*t.pieces(1, messages=iter(MESSAGES))]
    assert "".join(p[1] for p in pieces) == text and [p[0] for p in pieces] == [0, 1, 9, 15, 32][: len(pieces)] and [s for p in pieces for s in p[2]] == spans
    assert t.streams("messages") and not Template("{{ messages | length }}{% for m in messages %}{% endfor %}").streams("messages")
    assert [*Template("").pieces(9)] == [(0, "", [])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["\\", "\n", "<turn>", "</turn>", "</tur", "n>", "<", ">", "a", "Ü", "\\n", "\r"]), max_size=12).map("".join), st.lists(st.sampled_from(["\\", "\n", "<turn>", "</turn>", "</tur", "n>", "\\<turn>", "assistant"]), max_size=12).map("".join)), max_size=6))
def test_turns_round_trip(turns):
    escaper = chats.Escaper()
    text, spans = Template(chats.TURNS, escaper.filters()).render(messages=[{"role": r, "text": x} for r, x in turns])
    assert [*chats.turns_of(text, escaper)] == turns
    assert [escaper.unescape(text[a:b]) for a, b in spans] == [x for r, x in turns if r == "assistant"]


def test_control_strings_may_not_overlap():
    for bad in (("aa",), ("ab", "ba"), ("ab", "xaby"), ("",), ("a\\b",), ("a\nb",)):
        with pytest.raises(ValueError):
            chats.Escaper(bad)
    own = chats.Escaper(("[INST]", "[/INST]"))
    assert own.escape("\\[INST] [/INST") == "\\\\[INST] [/INST" and own.unescape(own.escape("\\[INST]")) == "\\[INST]"


SCHEMA = "conv_id long, turn long, role string, text string, piece string, spans int"
TURNS = [(1, 1, "assistant", "b</turn>"), (1, 0, "user", "a\\"), (2, None, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", "tie"), (2, 0, "a", "tie"), (None, 1, "assistant", "no id"), (None, 0, "user\n\\", "<turn>"), (3, 5, "assistant", "x"), (3, 5, "assistant", "x"), (4, 0, "assistant", "Ü" * 2_000_000 + "\n</turn>\n")]


def brute(rows):
    groups = {}
    for conv, turn, role, text in [*rows, (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        yield conv, len(turns), sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest()


def test_conversations(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in TURNS], SCHEMA).repartition(3)
    got = chats.digest(docs).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(brute(TURNS), key=str)
    assert {r["conv_id"]: r["formatted_chars"] for r in got}[3] == 2 * len("<turn>assistant\nx\n</turn>\n")
    assert [r["conv_id"] for r in chats.digest(docs.limit(0)).collect()] == [-7]


def test_a_long_conversation_in_pieces(spark):
    rows = [(9, i, "assistant" if i % 2 else "user", f"turn {i} </turn>") for i in range(3000)]
    docs = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA).repartition(4)
    pieces = chats.formatted(docs, piece=1000)
    assert 40 < pieces.count() < 3000
    assert sorted(tuple(r)[:5] for r in chats.read_back(pieces).collect()) == [x for x in brute(rows) if x[0] == 9]


def test_other_templates(spark):
    docs = spark.createDataFrame([(*r, None, None) for r in TURNS[:2]], SCHEMA)
    rows = chats.formatted(docs, "{{ messages | length }}{% for m in messages %}[INST]{{ m.text | escape }}[/INST]{% endfor %}", ("[INST]", "[/INST]")).collect()
    assert [r["formatted"] for r in rows] == ["2[INST]a\\[/INST][INST]b</turn>[/INST]"]
    with pytest.raises(TemplateError):
        chats.formatted(docs, "{{ messages.pop() }}")
