"""The literal reader against Python's own evaluator."""

import ast
import json
import random
import time
import warnings

import pytest
from conftest import SF0001
from hypothesis import given, settings
from hypothesis import strategies as st

from cxpulse.functions.literal import _storable, parse_list_literal, read_list, read_literal
from cxpulse.operators.prepare import prepare
from cxpulse.plans.catalog import hard_literals
from cxpulse.sources.fixtures import python_list_repr
from cxpulse.sources.inputs import table

warnings.simplefilter("ignore", SyntaxWarning)

CASES = ["[]", "[1]", "[1,]", "[,]", "['a', \"b\"]", "['a' 'b']", "['a' b'c']", "[b'a' b'\\xff', rb'\\x']", "['''x\ny''']", "['x\ny']",
         "['x\\\ny']", "[u'a', R'\\n', f'a']", "['\\x41\\u00e9\\U0001F600\\N{BULLET}\\101\\q']", "['\\x4']", "['\\N{NO SUCH}']", "['\\u12']",
         "['\\U00110000']", "['\\ud83d\\ude00', '\\ud800']", "[None, True, False, ...]", "[none]", "[null]", '["a", null, true, 1.0]',
         "[1, -2, +3, --4, 1.50, .5, 1., 1e3, 1E-3, 1_000, 1__0, 0x1F, 0b11, 0o17, 00, 01, 0_0]", "[0x1F, 0b11, 0o17, 00, 0_0, 1_0.5_0]",
         "[1+2j, -1-2j, 1j, -3j, (1)+2j, 5J]", "[1+2]", "[1j+2]", "[1+2j+3j]", "[-'a']", "[-True]", "[(1), (1,), (), ((2))]", "[(,)]", "[('a') 'b']",
         "[{}, {1: 2}, {1, 2}, {1: 2,}, set(), {'a': [1, {'b': None}]}]", "[{[1]: 2}]", "[{1: }]", "[{1, 2: 3}]", "[{1: 2, 3}]", "[{**{}}]",
         "[1] # ]", "[1\n# c ]\n]", "[1], [2]", "[1] [2]", "[1] + [2]", "[[1]", "[1]]", "[(1]", "['a'", "['a', 'b' x 'c']", "[a]", "[f()]", "[1 if 1 else 2]",
         "[1 2]", "['a' 1]", "[1 'a']", "[None 'a']", "['a'None]", "[1a]", "[09]", "[09.5]", "[1..2]", "[\u00a01]", "['\u00a0é']", "[ '\x00']", "['\t\x0c\x01']",
         "[\t1,\x0c2\r\n,3\r]", "['a\r\nb']", "['''a\r\nb''']", "[1,\\\n2]", "[1 \\ \n]", "['a'\n'b']", "['it''s']", "['l\\'été', \"d'\\\"x\\\"\"]", "[" * 60 + "]" * 60,
         "[set ()]", "[set([1])]", "[Ellipsis]", "[...,]", "[1.e5, 1.j]", "['a', *[1]]", "[1:2]", "[lambda: 0]", "['%s' % 1]", "[-1 - 1j]", "[- 1]", "[+1j]", "[1 - -1j]",
         "[(-1)+2j]", "[-(1)]", "[-(-1)]", "[('a' 'b')]", "[ur'a', bu'a']", "[br'a', Rb'b']", "['''a'''\"\"\"b\"\"\"]", "['a''''b''']", "[''''a''']", "['''a'''']"]


def python(text):
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return NotImplemented


def mine(text):
    try:
        return read_literal(text)
    except ValueError:
        return NotImplemented


def check(text):
    want, got = python(text), mine(text)
    if isinstance(want, list) or isinstance(got, list):
        assert repr(got) == repr(want), text


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    check(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.recursive(st.one_of(st.text(), st.binary(max_size=8), st.integers(), st.floats(), st.booleans(), st.none(), st.complex_numbers()),
                             lambda x: st.one_of(st.lists(x, max_size=3), st.tuples(x, x), st.dictionaries(st.text(max_size=3), x, max_size=2)), max_leaves=8)))
def test_rendered_values(values):
    check(repr(values))
    check(ascii(values))


def test_mutated_lists():
    rng = random.Random(6)
    for text in CASES:
        for _ in range(60):
            t = list(text)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(t) + 1)
                t[i:i + rng.randint(0, 1)] = rng.choice("[](){},:'\"\\+-.1ejbruxN \n#aNone")
            check("".join(t).strip())


def expected(text):
    """A list text's messages by Python's evaluator, the json module and the quote split."""
    if text is None:
        return []
    text = text.strip()
    if not (text[:1] == "[" and text[-1:] == "]"):
        return [text]
    value = python(text)
    if not isinstance(value, list):
        try:
            value = json.loads(text)
        except ValueError:
            value = None
    if isinstance(value, list):
        return [_storable(str(v)) for v in value]
    return read_list(text)


def test_whole_conversations_table(spark):
    turns = table(spark, SF0001, "conversations")
    rows = hard_literals(turns).select("raw").union(
        turns.selectExpr("collect_list(text) OVER (PARTITION BY conv_id ORDER BY turn) AS l").select(python_list_repr("l").alias("raw")))
    rng = random.Random(7)
    texts = [r["raw"] for r in rows.collect()]
    for t in texts[:]:  # mutated: a character dropped, doubled or replaced
        i = rng.randrange(len(t))
        texts.append(t[:i] + rng.choice(["", t[i] * 2, "'", "\\", "]", ", "]) + t[i + 1:])
    texts += [None, "", " ", "plain", "[", "]", "[]", " [ ] ", "['\\ud800', 'a']"] + CASES
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(4)
    got = {r["i"]: r["m"] for r in df.select("i", parse_list_literal("t").alias("m")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == expected(t), t


def test_linear_in_the_text():
    for text in ("[" + "'a', " * 300_000 + "]", "['" + "x" * 3_000_000 + "']", "['" + "\\x41" * 400_000 + "']", "[" + "'a' " * 300_000 + "]",
                 "['''" + "'' " * 400_000 + "''']", "[" + " " * 2_000_000 + "]", "['" + "\\" * 1_000_001 + "']", "[" + "1" * 4000 + "]", "[" * 5000 + "]" * 5000):
        start = time.time()
        read_list(text)
        assert time.time() - start < 5


def test_prepare_with_the_literal_parser(spark):
    rows = [("1", "['bon\\x6aour', None, \"l'ami\"]"), ("2", None), ("3", "[]"), ("4", "pas une liste"), ("4", "pas une liste")]
    got = prepare(spark.createDataFrame(rows, "conversation_id string, verbatims string"), date_col=None, parser="literal")
    assert sorted((r["conversation_id"], r["verbatim"], r["n_messages"]) for r in got.collect()) == [
        ("1", "bonjour. None. l'ami", 3), ("4", "pas une liste", 1), ("4", "pas une liste", 1)]
