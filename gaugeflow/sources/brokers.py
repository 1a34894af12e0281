"""Message brokers without a Spark connector, as a Python streaming source that polls.

A poller is a function (options, position) -> (texts, next position); the position is a dict that Spark
keeps in the stream's checkpoint, so a restarted stream goes on where it stopped. The pollers of Kinesis and
of an MQTT topic need their client libraries on the driver.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

Poller = Callable[[Mapping[str, str], dict], tuple[list[str], dict]]
#: Records in a call, seconds to wait on the topic, and between calls (five a second are allowed).
RECORDS, WAIT_S, PAUSE_S = 100, 1.0, 0.2


def poll_lines(options: Mapping[str, str], position: dict) -> tuple[list[str], dict]:
    """New whole lines of a growing file; a line longer than the option bytes is read whole."""
    with open(options["path"], "rb") as lines:
        lines.seek(position.get("at", 0))
        data = lines.read(int(options.get("bytes", 1 << 20)))
        if b"\n" not in data:
            data += lines.readline()
    whole = data[: data.rfind(b"\n") + 1]
    return whole.decode("utf-8", "replace").splitlines(), {"at": position.get("at", 0) + len(whole)}


def poll_kinesis(options: Mapping[str, str], position: dict) -> tuple[list[str], dict]:
    """Records of all shards of a stream, each from its own sequence number.

    A shard that had no record yet is read from the time of its first poll, which the position keeps, so that
    nothing between two polls is lost; with from=TRIM_HORIZON from its beginning.
    """
    client = _kinesis(options)
    texts, after = [], dict(position)
    for name in _shards(client, options["stream"]):
        seen = after.get(name)
        if isinstance(seen, str):
            start = {"ShardIteratorType": "AFTER_SEQUENCE_NUMBER", "StartingSequenceNumber": seen}
        elif options.get("from", "LATEST") == "LATEST":
            seen = after.setdefault(name, time.time() if seen is None else seen)
            start = {"ShardIteratorType": "AT_TIMESTAMP", "Timestamp": seen}
        else:
            start = {"ShardIteratorType": options["from"]}
        found = client.get_records(ShardIterator=client.get_shard_iterator(StreamName=options["stream"], ShardId=name, **start)["ShardIterator"], Limit=RECORDS)
        for record in found["Records"]:
            texts.append(record["Data"].decode("utf-8", "replace"))
            after[name] = record["SequenceNumber"]
        time.sleep(PAUSE_S)
    return texts, after


def _kinesis(options: Mapping[str, str]):
    import boto3

    return boto3.client("kinesis", region_name=options.get("region"))


def _shards(client, stream: str) -> list[str]:
    """Names of all shards of a stream, page by page."""
    page = client.list_shards(StreamName=stream)
    names = [s["ShardId"] for s in page["Shards"]]
    while token := page.get("NextToken"):
        page = client.list_shards(NextToken=token)
        names += [s["ShardId"] for s in page["Shards"]]
    return names


def poll_mqtt(options: Mapping[str, str], position: dict) -> tuple[list[str], dict]:
    """Messages that reach a topic while it is listened to; the broker keeps no position."""
    import paho.mqtt.client as mqtt

    texts: list[str] = []
    client = mqtt.Client(mqtt.CallbackAPIVersion.VERSION2, client_id=options.get("client", ""), clean_session=not options.get("client"))
    client.on_message = lambda _client, _data, message: texts.append(message.payload.decode("utf-8", "replace"))
    client.connect(options["host"], int(options.get("port", 1883)))
    client.subscribe(options.get("topic") or f"v1.0/Datastreams({options['datastream']})/Observations", qos=1)
    end = time.time() + WAIT_S
    while time.time() < end:
        client.loop(0.1)
    client.disconnect()
    return texts, {"n": position.get("n", 0) + len(texts)}


POLLERS: dict[str, Poller] = {"lines": poll_lines, "kinesis": poll_kinesis, "mqtt": poll_mqtt}


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]):
        self.options = options
        self.kept: list[tuple[str, list[str]]] = []

    def initialOffset(self) -> dict:
        return {}

    def read(self, start: dict) -> tuple[Iterator[tuple[str]], dict]:
        texts, end = POLLERS[self.options["kind"]](self.options, start)
        self.kept.append((json.dumps([start, end], sort_keys=True), texts))
        return iter([(t,) for t in texts]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str]]:
        wanted = json.dumps([start, end], sort_keys=True)
        texts = next((t for key, t in self.kept if key == wanted), None)
        if texts is None:
            texts = POLLERS[self.options["kind"]](self.options, start)[0]
        return iter([(t,) for t in texts])

    def commit(self, end: dict) -> None:
        self.kept = self.kept[-2:]


class Broker(DataSource):
    """format('broker'): option kind (lines, kinesis, mqtt) and those of its poller; one column, value."""

    @classmethod
    def name(cls) -> str:
        return "broker"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(dict(self.options))
