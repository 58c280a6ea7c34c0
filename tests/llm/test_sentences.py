import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grovekit.llm.sentences import cut_text, events, machine, sentence_units, split_sentences
from grovekit.scale import Workspace

CASES = [
    ["Kamera mati lagi!", "Suhu 9,42°C, lembap 58%, angin pelan."],
    ["Lihat Gbr. 2 dan Tbl. 53 untuk letak pelepah.", "Rasio B2 vs. B3 kira-kira 1:2,490 menurut petugas."],
    ["Nilai mAP50 dianggap wajar oleh Dr. B. dari lab mitra.", "Ada 23 kotak, pelepah, dll. yang belum punya kelas."],
    ["Kel. 2 s.d. 29 memakai kamera lama, dsb.", "Pencatat menunggu."],
    ['Pencatat bertanya, "Kotak yang mana?", tetapi pencatat diam.', 'Petugas menjawab: "Foto ulang saja."', "Ada lagi."],
    ['"Is the box counted twice?" asked the night job.', "Done?"],
    ["Sisi kanan tampak samar... lalu operator memeriksa lagi.", "Berkas best.pt rusak?!", "Lanjut dari cfg.rgbd8.yaml!"],
    ["It was at 10.29 a.m. by the clock.", "We left at 9 p.m.", "The end."],
    ["(Siapa yang memeriksa tandan itu?)", "Menurut pencatat (\"jangan dihapus!\"), sisi kanan tetap."],
    ["mAP50 0.576 lebih tinggi.", "yolo26l berhenti.", "epoch 90: box_loss 0.490."],
]
TIGHT = [
    ["叶柄很模糊……但标注员删除了类别标签。", "不要动树冠！", "“请不要删除！”夜间任务说，“果串还要用。”", "文件side_4.jpg由标注员合并了。"],
    ["「まだ消すな。区分の札を使う。」と確認者が言った。", "注釈係は「重複か？」と尋ねた。", "side_4.jpgは注釈係が消した。"],
]


@pytest.mark.parametrize("want", CASES)
def test_sentences(want):
    text = " ".join(want)
    assert [text[a:b] for a, b in split_sentences(text)] == want


@pytest.mark.parametrize("want", TIGHT)
def test_scripts_without_blanks(want):
    text = "".join(want)
    assert [text[a:b] for a, b in split_sentences(text)] == want


def test_other_scripts():
    for want in (["गुच्छे को मत छुओ!", "डॉ. क ने गुच्छे को हटाया।", '"इसे मत हटाओ!" टिप्पणीकार ने कहा।', "चित्र सं. 0.2 देखें, गुच्छे नीचे है।"],
                 ["سأل مهمة الليل: «هل تكرر وسم الصنف؟»", "لا تلمس قمة الشجرة!"], ["ห้ามแตะป้ายชั้น", "ด้านที่ 1 มีป้ายชั้น 88 ชิ้น", "ไฟล์ side_1.jpg ถูกลบโดยผู้ตรวจ"]):
        text = " ".join(want)
        assert [text[a:b] for a, b in split_sentences(text)] == want


def test_layout():
    text = "Bab 3. Anotasi\r\n\r\nKalimat satu\nyang dibungkus. Dua\n \n\nDaftar:\n1. Satu. Lagi!\n2) bukan\n2. Dua\n• tiga\n\n1.2 Hasil\n\nakhir tanpa titik"
    assert [text[a:b] for a, b in split_sentences(text)] == [
        "Bab 3. Anotasi", "Kalimat satu\nyang dibungkus.", "Dua", "Daftar:", "1. Satu.", "Lagi!", "2) bukan", "2. Dua", "• tiga", "1.2 Hasil", "akhir tanpa titik"]


def test_missing_blank():
    text = "Jangan mencocokkan sebelum selesai!Lanjut dari cfg.rgbd8.yaml!Suhu 48,106°C.Tim bertanya, \"Kotak?\""
    assert [text[a:b] for a, b in split_sentences(text)] == ["Jangan mencocokkan sebelum selesai!", "Lanjut dari cfg.rgbd8.yaml!", "Suhu 48,106°C.", 'Tim bertanya, "Kotak?"']


def test_no_text():
    assert split_sentences(None) == split_sentences("") == split_sentences(" \n\t ") == []
    assert split_sentences("...") == [(0, 3)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='aB1 .?!…"“”()。\n，ก\tx:', max_size=120))
def test_every_character_is_in_one_sentence(text):
    spans = split_sentences(text)
    covered = [i for a, b in spans for i in range(a, b)]
    assert len(covered) == len(set(covered))
    assert all(text[i].isspace() for i in set(range(len(text))) - set(covered))
    assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)


def test_chunks_agree_with_the_whole(spark):
    para = " ".join(" ".join(c) for c in CASES) + "\n\n" + "".join(TIGHT[0]) + "\n\nDaftar:\n1. Satu\n2. Dua\n\n"
    texts = [para * 8, "kata " * 3000, 'buka "' + "isi. " * 500 + '" tutup.', None, "", "  ", para, para]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "a", 1, "x")], "doc_id bigint, text string, state int, k string")
    got = {(r.doc_id, r.start_pos, r.end_pos) for r in sentence_units(df, Workspace(spark, "t"), chunk=256).collect()}
    assert got == {(i, a, b) for i, t in enumerate(texts) for a, b in split_sentences(t)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert sentence_units(df, Workspace(spark, "t")).count() == 0


def test_machine_is_finite():
    assert machine().size < 10000 and machine().next_.max() < machine().size


def by_chunks(text, chunk):
    """The spans read chunk by chunk, each with its own stretch of text only."""
    m, state, cuts = machine(), 0, []
    for begin, lo, hi, seen, part in cut_text(text, chunk):
        for code, stop in events(part, lo - begin, hi - begin, begin == 0, seen):
            state, ends = m.steps[code][state]
            if ends:
                cuts.append(begin + stop)
    spans = []
    for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
        part = text[a:b]
        if part.strip():
            spans.append((a + len(part) - len(part.lstrip()), b - (len(part) - len(part.rstrip()))))
    return spans


PIECES = ["Kalimat satu.", "Dua?", " ", "  ", "\n", "\n\n", "\n1. satu", "\n2. dua", "\n3) tiga", '"', "(", ")", "「", "」", "果串。", "a.m. ", "3.5", "…", "x" * 70, " " * 80, "\n" * 70, "." * 66, "Bab 3. A", "\n\n1.2 Hasil", "ป้าย ป้าย"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.sampled_from([1, 7, 64]))
def test_any_chunk_reads_like_the_whole(pieces, chunk):
    text = "".join(pieces)
    assert by_chunks(text, chunk) == split_sentences(text)


def test_runs_and_items_of_any_length():
    gap = "Kalimat satu. " + "x" * 8100 + "." + " " * 9000 + "Kalimat dua. Tiga."
    lines = "Kalimat satu." + "\n" * 7000 + "Dua. Tiga."
    items = "Daftar:\n1. " + "kata " * 700 + "\n2. Dua\n3. Tiga"
    for text in (gap, lines, items):
        assert by_chunks(text, 64) == by_chunks(text, 8192) == split_sentences(text)
    assert [items[a:b][:2] for a, b in split_sentences(items)] == ["Da", "1.", "2.", "3."]


def test_deep_brackets():
    text = "(a (b (c (d! e) f) g) h) selesai. Dua."
    assert [text[a:b] for a, b in split_sentences(text)] == ["(a (b (c (d! e) f) g) h) selesai.", "Dua."]
