"""Q1: tokenizers' own chat templates as Column expressions, against text made by hand."""

import pytest

from diffcorpus.functions.chat import CHATML, render_chat
from diffcorpus.functions.templates import CHATML_WITH_DEFAULT, INST, ModelTemplate

CHATS = {
    "full": [("system", "be brief"), ("user", " hi\n"), ("assistant", "yo ")],
    "no system": [("user", "a"), ("assistant", "b"), ("user", "c")],
    "late system": [("user", "a"), ("system", "s")],
    "nulls": [("system", "s"), ("user", None)],
    "none": [],
}


def rendered(spark, template, chats, generation=False):
    df = spark.createDataFrame(list(chats.items()), "name string, messages array<struct<role string, content string>>")
    return {r.name: r.text for r in df.select("name", render_chat("messages", template, generation).alias("text")).collect()}


def chatml(chat, generation):
    if not chat or chat[0][0] != "system":
        chat = [("system", "help"), *chat]
    return "".join(f"<|im_start|>{r}\n{c or ''}<|im_end|>\n" for r, c in chat) + ("<|im_start|>assistant\n" if generation else "")


def inst(chat):
    system = chat[0][1] if chat and chat[0][0] == "system" else None
    out = ""
    for k, (role, content) in enumerate(chat[1:] if system is not None else chat):
        if k == 0 and system is not None:
            content = f"<<SYS>>\n{system}\n<</SYS>>\n\n{content or ''}"
        out += f"<s>[INST] {(content or '').strip()} [/INST]" if role == "user" else f" {content.strip()} </s>"
    return out


@pytest.mark.parametrize("generation", [False, True])
def test_layout_with_a_default_system_text(spark, generation):
    template = ModelTemplate(CHATML_WITH_DEFAULT, {"default_system": "help"})
    assert rendered(spark, template, CHATS | {"null": None}, generation) == {n: chatml(c, generation) for n, c in CHATS.items()} | {"null": None}


def test_bracketed_layout_and_its_order_of_roles(spark):
    template = ModelTemplate(INST, {"bos_token": "<s>", "eos_token": "</s>"})
    good = {n: c for n, c in CHATS.items() if n != "late system"}
    assert rendered(spark, template, good) == {n: inst(c) for n, c in good.items()}
    with pytest.raises(Exception, match="roles must alternate"):
        rendered(spark, template, {"twice": [("user", "a"), ("user", "b")]})


def test_plain_parts_as_a_template(spark):
    same = "{% for message in messages %}{{'<|im_start|>' + message['role'] + '\\n' + message['content'] + '<|im_end|>' + '\\n'}}{% endfor %}{% if add_generation_prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}"
    chats = {n: c for n, c in CHATS.items() if n != "nulls"}
    for generation in (False, True):
        assert rendered(spark, ModelTemplate(same), chats, generation) == rendered(spark, CHATML, chats, generation)


@pytest.mark.parametrize(
    "source,want",
    [
        ("{% for m in messages %}{{ loop.index }}{% if not loop.last %}, {% endif %}{% endfor %}", "1, 2, 3"),
        ("a\n  {% if tools %}\nx{{ tools[0] }}\n  {% elif tools is defined %}y{% else %}\nz\n  {% endif %}\nb\n", "a\nz\nb"),
        ("{# note #}{{ messages | length }}{{ messages[-1]['role'] }}", "3assistant"),
        ("{{ 'a|b~c' ~ messages[1].content.strip() }}{{ messages[9].content }}", "a|b~chi"),
        ("{%- for m in messages -%}  {{ m.content | trim + '.' }}  {%- endfor -%}", "be brief.hi.yo."),
        ("{{ 'x' if messages[0].role in ['system', 'tool'] else 'y' }}{{ 'i' if 'br' in messages[0].content else 'o' }}", "xi"),
        ("{% set n = 'out' %}{% for m in messages %}{% set n = 'in' %}{% endfor %}{{ n }}", "out"),
        ("{% for m in messages %}{% if m.role == 'user' %}U{% elif m.role == 'system' %}S{% else %}A{% endif %}{% endfor %}", "SUA"),
    ],
)
def test_parts_of_templates(spark, source, want):
    assert rendered(spark, ModelTemplate(source), {"x": CHATS["full"]})["x"] == want


@pytest.mark.parametrize("source", ["{% macro x() %}", "{% if a %}", "{{ a b }}", "{{ messages | tojson }}", "{% endfor %}", "{% for t in tools %}{% endfor %}", "{{ messages }}", "{{ f(1) }}"])
def test_what_is_not_supported_is_refused(spark, source):
    with pytest.raises(ValueError, match="template"):
        ModelTemplate(source).render("messages")
