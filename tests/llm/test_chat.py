import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from sabermill.llm import chat
from sabermill.llm.queries import op6_chat

AWKWARD = st.text(alphabet=st.sampled_from(list("<s>/[INST]\\ a\né世")), max_size=40)


@given(AWKWARD)
@settings(max_examples=300, deadline=None)
def test_escape_round_trip(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "x y"]) | AWKWARD, AWKWARD), max_size=5))
@settings(max_examples=200, deadline=None)
def test_render_round_trip(turns):
    text, spans = chat.Template().render([{"role": r, "text": t} for r, t in turns])
    assert chat.read_turns(text) == turns
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def test_language():
    run = lambda source, *m: chat.Template(source).render([{"role": "r", "text": x} for x in m])[0]
    assert run("{% for m in messages %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}", "a", "b") == "1,2"
    assert run("{% set x = 'a' + 'b' %}{{ x | upper ~ 1 }}{# no #}{{ 'y' if 1 < 2 and x == 'ab' else 'n' }}") == "AB1y"
    assert run("{% for m in messages %}{% if m['text'] == 'a' %}A{% elif 'b' in m.text %}B{% else %}{{ m.none | default('-') }}{% endif %}{% endfor %}", "a", "cb", "x") == "AB-"
    assert chat.Template("a{{ 'b' ~ 2 }}{% if 1 == 2 %}x{% else %}c{% endif %}").tree == [("text", ("const", "ab2c"))]


@pytest.mark.parametrize("bad", ["{{ }}", "{% for x in y %}{% endfor %}", "{% if 1 %}", "{{ a b }}", "{{ x | eval }}", "{% include x %}", "{{ ''.__class__ }}{{ f() }}"])
def test_sandbox(bad):
    with pytest.raises(chat.TemplateError):
        chat.Template(bad).render([])


DOUBLING = "{% set a = 'abcdefgh' %}" + "{% set a = a ~ a %}" * 40 + "{{ a }}"


@pytest.mark.parametrize("bad", [DOUBLING, "{{ " + "(" * 5000 + "1" + ")" * 5000 + " }}", "{{ " + "not " * 5000 + "1 }}", "{{ 1" + " + 1" * 5000 + " }}", "{{ x" + ".y" * 5000 + " }}", "{{ x" + " | trim" * 500 + " }}", "{% if 1 %}" * 500 + "{% endif %}" * 500,
    "{{ " + "9" * 5000 + " }}", "{{ 'a' < 1 }}", "{{ 1 + 'a' }}", "{{ 'a' | default('b', 'c') }}", "{{ 1 not 2 }}", "x" * (1 << 17)])
def test_bounds(bad):
    with pytest.raises(chat.TemplateError):
        chat.Template(bad).render([])


def test_errors_at_run_time():
    for bad in ("{% for m in messages %}{{ m.text < 1 }}{% endfor %}", "{% for m in messages %}{{ m.text + 1 }}{% endfor %}", "{% for m in messages %}{{ m[m] }}{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad).render([{"role": "r", "text": "x"}])
    assert chat.Template("{{ 'a' if 'b' not in 'cd' and not 1 > 2 else 'n' }}").render([])[0] == "a"


def test_no_python_attributes():
    with pytest.raises(chat.TemplateError):
        chat.Template("{% set x = 'a' %}{{ x.__class__ }}").render([])


def test_query_digests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 50)
    rows = [(1, 1, "assistant", "b\\ </s>"), (1, 0, "user", "a"), (2, 0, None, None), (3, 0, "user", "<s>[INST] x"), (3, 0, "user", "<s>[INST] x"), (None, 0, "assistant", "z")]
    rows += [(4, i, "assistant" if i % 2 else "user", "é" * i) for i in range(30)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    probe = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", probe), (-1, 1, "assistant", probe)]
    got = {r.conv_id: r for r in op6_chat(spark, str(tmp_path)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted([(t, r or "", x or "") for c, t, r, x in rows if c == conv])
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == len(chat.Template().render([{"role": a, "text": x} for _, a, x in own])[0])
    empty = chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert empty.count() == 0 and chat.read_back(empty).count() == 0
