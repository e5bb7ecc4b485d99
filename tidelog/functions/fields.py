"""Fields of messages, identities and settings, as columns: texts, hexadecimal bytes, sizes, tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_BYTES = 32
#: Ports under this one need privileges; 0 is any port.
LEAST_PORT = 1024
#: What a synchronisation event says of the state.
STATES = {"started": "Loading", "progress": "Loading", "ready": "Completed", "replicated": "Replicating", "error": "Failed"}


def strict_text(value: Column) -> Column:
    """Bytes as text; null if they aren't UTF-8."""
    return F.when(F.is_valid_utf8(value.cast("string")), value.cast("string"))


def lossy_text(value: Column) -> Column:
    """Bytes as text, with marks in place of what isn't UTF-8."""
    return F.make_valid_utf8(value.cast("string"))


def size_of(text: Column) -> Column:
    """A size that is written in digits; null if it isn't."""
    return F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("long"))


def hex_bytes(text: Column) -> Column:
    """The bytes of hexadecimal digits; null if they are none."""
    return F.when(text.rlike("^(?:[0-9a-fA-F]{2})*$"), F.unhex(text))


def hex_list(texts: Column) -> Column:
    """The bytes of all hashes; null if one of them is not hexadecimal."""
    return F.when(F.forall(texts, lambda x: hex_bytes(x).isNotNull()), F.transform(texts, hex_bytes))


def public_key(text: Column) -> Column:
    """A key of 32 bytes in hexadecimal digits, else null."""
    return F.when(F.octet_length(hex_bytes(text)) == KEY_BYTES, hex_bytes(text))


def signatures(id_: Column, pub_key: Column) -> Column:
    """The map of an identity's signatures, without those that aren't hexadecimal."""
    both = F.map_from_arrays(F.array(F.lit("id"), F.lit("publicKey")), F.array(hex_bytes(id_), hex_bytes(pub_key)))
    return F.map_filter(both, lambda _, v: v.isNotNull())


def event_state(event: Column) -> Column:
    """The state of synchronisation after an event."""
    found = F.lit(None).cast("string")
    for name, state in STATES.items():
        found = F.when(event == name, state).otherwise(found)
    return found


def config_error(port: Column, path: Column, cache_bytes: Column) -> Column:
    """What is wrong with settings, the first thing only; null if they are valid. A null path keeps data in memory."""
    return F.when((port > 0) & (port < LEAST_PORT), "port").when(path == "", "path").when(cache_bytes == 0, "cache")


def same_address(root_a: Column, path_a: Column, root_b: Column, path_b: Column) -> Column:
    return root_a.eqNullSafe(root_b) & path_a.eqNullSafe(path_b)
