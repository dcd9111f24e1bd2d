"""All registered queries and their SQL."""

from __future__ import annotations

from . import core, media, speech

QUERIES: dict = {**core.QUERIES, **speech.QUERIES, **media.QUERIES}
ORACLES: dict = {**core.ORACLES, **speech.ORACLES, **media.ORACLES}
