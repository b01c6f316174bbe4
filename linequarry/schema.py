"""Schemas of the tables that a scan passes along."""

from __future__ import annotations

#: A recovered blob; container is '' for loose files.
SCRIPTS = "engine string, virtual_path string, container string, data binary, size long, error string"
#: One extracted line.
LINES = "index long, speaker string, text string, source string, engine string, container string"
#: One row for each script, the overridden ones after the kept ones.
REPORT = "virtual_path string, engine string, container string, size long, line_count long, encoding string, note string, error string"
#: Input of speaker tracking.
CANDIDATES = "script_id string, line_no int, hint string, line string"
#: Listing of files under a root.
FILES = "path string, rel string, length long, head binary"
