"""Expressions are built with few messages to the JVM; attributes are read as written."""

from py4j.clientserver import ClientServerConnection
from pyspark.sql import functions as F

from pagewatch.functions import html as H
from pagewatch.functions import text as X


def calls(monkeypatch, build):
    """Calls of JVM methods that building an expression takes."""
    sent = []
    send = ClientServerConnection.send_command

    def counted(self, command):
        sent.append(command)
        return send(self, command)

    with monkeypatch.context() as patch:
        patch.setattr(ClientServerConnection, "send_command", counted)
        build()
    return sum(c.startswith("c\n") for c in sent)


def test_decoding_is_built_with_few_calls(spark, monkeypatch):
    # It took 236 calls, at each of 14 places of a profile.
    assert calls(monkeypatch, lambda: X.decode_entities(F.col("t"))) < 120


def test_attributes_as_written(spark):
    tag = "<a-b x title=no HREF = '/q\"' href=/r/ title=\"it's\n\" alt=''>"
    listed = H.attribute_list(F.lit(tag))
    row = spark.range(1).select(*[H.listed_attribute(listed, n) for n in ("x", "href", "title", "alt", "none")]).first()
    assert tuple(row) == ("", "/r/", "it's\n", "", None)
    mixed = spark.createDataFrame([("<p iTeMTYPE='q'>",), ("<p empty MTY>",)], "h string")
    assert [r[0] for r in mixed.select(H.item_types(F.col("h"))).collect()] == [["q"], []]
