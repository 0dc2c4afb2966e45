import pytest
from pyspark.sql import types as T

from parley import operators as op
from parley.operators.layout import detect_media

MESSAGE = "STRUCT<role: STRING, content: STRING>"


def layout(ddl, **options):
    return op.detect_layout(T.StructType.fromDDL(ddl), ("id",), **options)


@pytest.mark.parametrize(
    "ddl, kind, columns",
    [
        (f"id INT, conversations ARRAY<{MESSAGE}>, extra INT", "conversations", ("conversations",)),
        (f"id INT, Conversation ARRAY<{MESSAGE}>", "conversations", ("Conversation",)),
        (f"id INT, messages ARRAY<{MESSAGE}>", "messages", ("messages",)),
        (f"id INT, TEXTS ARRAY<{MESSAGE}>, question STRING, answer STRING", "messages", ("TEXTS",)),
        ("id INT, messages ARRAY<MAP<STRING, STRING>>", "messages", ("messages",)),
        ("id INT, question STRING, answer STRING", "question", ("question", "answer")),
        ("id INT, Questions STRING, ANSWERS STRING", "question", ("Questions", "ANSWERS")),
        (
            "id INT, definition STRING, input STRING, output STRING",
            "instruction",
            ("definition", "input", "output"),
        ),
        (
            "id INT, instruction STRING, input STRING, output STRING",
            "instruction",
            ("instruction", "instruction", "output"),
        ),
        (
            "id INT, input STRING, instruction STRING, output STRING",
            "instruction",
            ("instruction", "input", "output"),
        ),
        ("id INT, rejected STRING, chosen STRING", "preference", ("chosen", "rejected")),
        ("id INT, role STRING, text STRING", "role_text", ("role", "text")),
        ("id INT, text STRING, caption STRING", "caption", ("caption",)),
        ("id INT, caption STRING, label INT", "caption", ("caption",)),
        ("id INT, label INT, images ARRAY<STRING>", "label", ("label",)),
    ],
)
def test_first_rule_that_fits(ddl, kind, columns):
    found = layout(ddl)
    assert (found.kind, found.columns) == (kind, columns)


def test_a_message_column_that_is_no_list_is_not_used():
    # The first message name decides, even if a later one is a list.
    found = layout(f"id INT, messages STRING, texts ARRAY<{MESSAGE}>, question STRING, answer STRING")
    assert found.kind == "question"
    assert layout("id INT, content ARRAY<STRING>, question STRING, answer STRING").kind == "question"


def test_distinct_columns():
    ddl = "id INT, instruction STRING, input STRING, output STRING"
    found = layout(ddl, distinct_columns=True)
    assert found.columns == ("instruction", "input", "output")


def test_names_match_whole_and_ids_never():
    with pytest.raises(op.UnsupportedLayout):
        layout("id INT, my_question STRING, answer STRING")
    with pytest.raises(op.UnsupportedLayout):
        op.detect_layout(T.StructType.fromDDL("label INT, foo STRING"), ("label",))
    with pytest.raises(op.UnsupportedLayout):
        layout("id INT, foo STRING, bar STRING")


def test_media_in_kind_order():
    ddl = "id INT, video STRING, Images ARRAY<STRING>, audios STRING, image STRING, imagery STRING"
    assert detect_media(T.StructType.fromDDL(ddl)) == ("Images", "image", "audios", "video")
