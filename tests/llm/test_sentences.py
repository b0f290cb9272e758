from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import sentence_rules as R
from sightline.llm.sentences import NUMBER, STATES, chunks, fan, pieces, scanned, sentence_ends, sentences, starts


def split(text):
    out, at = [], 0
    for e in sentence_ends(text):
        out.append(text[at:e].strip())
        at = e
    return out


@pytest.mark.parametrize(
    "parts",
    [
        ["According to Dr. Moll, the panel draws 22.5 W at full brightness.", "It supports 5G."], ["The owner said: \"It works. I checked it twice.\"", "We could not repeat that."], ["\"When will it ship?\" – \"In spring.\"", "Nobody knows."],
        ["The label reads \"Rated 5 V, 16.3 A. Indoor use only.\" in small print.", "See p. 7 of the guide."], ["The servers go down at 10 p.m.", "Yarn Labs will post a notice."], ["It got warm... then it recovered.", "That was it…", "The U.S. page lists it."],
        ["(The photo on page 11 shows a different phone.)", "Wait, what?!", "Go to support.Ravuld.example, open Downloads."], ["Am 3. Oktober startet der Verkauf, d. h. früher als geplant.", "Der 2. Versuch gelang gegen 7 Uhr."], ["„Das Scharnier sitzt fester.“", "So beschreiben es die Tester."],
        ["« Il charge encore ? » a demandé un testeur.", "Le code apparaît à l'art. 96 du certificat."], ["В 2031 г. модель появится в регионе ES.", "А. К. Петров написал отчёт."], ["¿Por qué?", "En EE. UU. el modelo no aparece."],
        ["All units carry a sticker; later ones don't.", "The page is gone."],
    ],
)
def test_latin_and_cyrillic(parts):
    assert split(" ".join(parts)) == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["工程师说：“铰链更紧了。”", "重启之后，联系人会恢复。", "标签上写着“仅限室内使用。”几个小字！", "“晚上还能充电吗？”一位用户问道。"], ["電池は約2.5時間もちました（28回の充電後）。", "「夜も充電できますか。」と利用者が尋ねました。", "少し熱くなりました…しかし、すぐに戻りました。"],
    ],
)
def test_scripts_without_spaces(parts):
    assert split("".join(parts)) == parts


def test_other_scripts():
    assert split("डॉ. Moll के अनुसार स्क्रीन 2.2 वाट लेती है। कीमत रु. 36 से शुरू होती है।") == ["डॉ. Moll के अनुसार स्क्रीन 2.2 वाट लेती है।", "कीमत रु. 36 से शुरू होती है।"]
    assert split("처음에는 뜨거워졌지만... 곧 돌아왔습니다. 화면이 밝아요! \"밤에도 되나요?\"라고 물었다.") == ["처음에는 뜨거워졌지만... 곧 돌아왔습니다.", "화면이 밝아요!", "\"밤에도 되나요?\"라고 물었다."]
    assert split("قال د. Moll إن الشاشة تستهلك 3.9 واط. «هل يشحن ليلاً؟» سأل أحد المستخدمين.") == ["قال د. Moll إن الشاشة تستهلك 3.9 واط.", "«هل يشحن ليلاً؟» سأل أحد المستخدمين."]
    assert split("ขนาดดาวน์โหลดคือ 4.0 GB Realme Narzo 77 Proได้รับการตั้งค่าใหม่ หน้าจอสว่างมากจริงๆ พบรหัส VV88407 ครั้งแรก") == ["ขนาดดาวน์โหลดคือ 4.0 GB", "Realme Narzo 77 Proได้รับการตั้งค่าใหม่", "หน้าจอสว่างมากจริงๆ", "พบรหัส VV88407 ครั้งแรก"]
    assert split("屏幕真亮 谁见过Nothing Phone 33 更新前请先备份数据") == ["屏幕真亮", "谁见过Nothing Phone 33", "更新前请先备份数据"]


def test_layout():
    assert split("Known issues\r\n\r\n- One, etc.\r\n- Two\r\n1. Three. Still three\r\n\r\nIt is a\r\nwrapped line. Joined.Next one.") == ["Known issues", "- One, etc.", "- Two", "1. Three. Still three", "It is a\r\nwrapped line.", "Joined.", "Next one."]
    assert split("no marks here\nnor here\n") == ["no marks here", "nor here"]
    assert split("") == split("  \n\t") == [] and sentence_ends(None) == []


@given(st.text(alphabet="aB. \"“”(«»!?。」「、：-\n1'…", max_size=200))
@settings(max_examples=300, deadline=None)
def test_ends_are_ordered_and_cover(text):
    ends = sentence_ends(text)
    assert ends == sorted(set(ends)) and all(0 < e <= len(text) for e in ends)
    assert not text.strip() or "".join(text[max(ends, default=0) :].split()) == ""


def test_functions_compose_as_the_run():
    text = 'He said: "One. Two." Then (three. Four.) five. „Sechs.“ Sieben. ' * 20
    marks = R.symbols(text, 0, len(text), frozenset())
    parts = [marks[i : i + 7] for i in range(0, len(marks), 7)]
    every = starts('"“„«‹「『»([{（【')
    assert set(every) == set(STATES)
    effects = []
    for p in parts:
        to = dict(zip(every, fan(p, every)[0], strict=True))
        effects.append(np.array([NUMBER[to[s]] for s in STATES]))
    before = scanned(np.stack(effects))
    state = R.START
    for p, b in zip(parts, before, strict=True):
        assert STATES[b] == state
        state, _ = R.run(p, state)
    assert len(NUMBER) == len(STATES)


def test_chunks_give_the_same_ends(spark):
    text = 'The owner said: "It works. I checked (twice. Really.) it." We could not repeat that. Update 2.3.4 fixes e.g. this, etc. '
    texts = [text * 40, (text * 3 + "\n\n") * 10, "屏幕真亮！“还能充电吗？”一位用户问道。" * 60, "- item one\n" * 200, "", None, " "]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(None, text, 0)], "doc_id long, text string, _ends int")
    want = {(i, e) for i, t in enumerate(texts) for e in sentence_ends(t)}
    for size in (100, 700, 100_000):
        got = [(r["doc_id"], r["end_char"]) for r in sentences(df, chunk=size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert sentences(df.limit(0)).count() == 0


SCRIPTS = [
    'The owner said: "It works. I checked (twice. Really.) it." We could not repeat that. Update 2.3.4 fixes e.g. this, etc. See https://ex.com/a.Next page. ', "屏幕真亮！“还能充电吗？”一位用户问道。工程师说：“铰链更紧了。”", "「夜も充電できますか。」と利用者が尋ねました。少し熱くなりました…しかし、すぐに戻りました。",
    "ขนาดดาวน์โหลดคือ 4.0 GB หน้าจอสว่างมากจริงๆ พบรหัส VV88407 ครั้งแรก ", "قال د. Moll إن الشاشة تستهلك 3.9 واط. «هل يشحن ليلاً؟» سأل أحد المستخدمين. ", "डॉ. Moll के अनुसार स्क्रीन 2.2 वाट लेती है। ", "„Das Scharnier sitzt fester.“ So beschreiben es die Tester. Am 3. Oktober startet der Verkauf. ",
    "В 2031 г. модель появится в регионе ES. А. К. Петров написал отчёт. ", "no marks here\nnor here\n", "\n\n- item one. two\n- item two\n\n", "(A note. In brackets.) ", "word.Word" * 12 + " ", "   ", "...", ")))", '"',
]


def chunked(text, size):
    import pandas as pd

    from sightline.llm.sentences import _chunked, _joined, _run

    rows = pd.concat(list(_chunked(iter([pd.DataFrame({"_id": [1], "_text": [text]})]), size)), ignore_index=True)
    return _joined(pd.concat(list(_run(iter([rows]))), ignore_index=True))["_ends"][0], len(rows) - 1


@given(st.lists(st.sampled_from(SCRIPTS), min_size=1, max_size=40), st.integers(1, 400))
@settings(max_examples=150, deadline=None)
def test_any_chunk_size_gives_the_same_ends(parts, size):
    text = "".join(parts)
    assert chunked(text, size)[0] == sentence_ends(text)


@pytest.mark.parametrize("part", ["電池は約2.5時間もちました。「夜も充電できますか。」と尋ねました。", "หน้าจอสว่างมากจริงๆพบรหัสครั้งแรก", "ア", "The phone is fine. "])
def test_long_texts_of_any_script_are_cut(part):
    text = (part * 92_000)[:92_000]
    ends, n = chunked(text, 8192)
    assert 11 <= n <= 14 and ends == sentence_ends(text)
    found = list(pieces(text))
    assert all(sum(s[1] - s[0] for s in spans) <= 9000 for spans in chunks(text, 8192, found))


def test_words_of_any_length_before_a_period():
    for n in (1, 10, 200, 20_000):
        assert split("See https://ex.com/" + "section/" * n + "section.Next page has it.") == ["See https://ex.com/" + "section/" * n + "section.Next page has it."]
        assert split("See " + "section/" * n + "section.Next page has it.") == ["See " + "section/" * n + "section.", "Next page has it."]
