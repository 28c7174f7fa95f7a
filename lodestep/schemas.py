"""Schemas of the source relations, the stored graph and the results."""

from __future__ import annotations

PAGE = "page_id long, namespace int, title string"
REDIRECT = "rd_from long, rd_namespace int, rd_title string"
LINKTARGET = "lt_id decimal(20,0), lt_namespace int, lt_title string"
PAGELINKS = "pl_from long, pl_target_id decimal(20,0)"
RELATIONS = {"page": PAGE, "redirect": REDIRECT, "linktarget": LINKTARGET, "pagelinks": PAGELINKS}

REDIRECTS = "source long, target long"
LINKS = "source long, target long"
# lists are cut into parts of bounded length; a part's number is its least id
INCOMING = "target long, part long, sources array<long>"
OUTGOING = "source long, part long, targets array<long>"
TABLES = {"redirects": REDIRECTS, "links": LINKS, "incoming": INCOMING, "outgoing": OUTGOING}
#: The column by which each table is sorted and looked up.
KEYS = {"redirects": "source", "links": "source", "incoming": "target", "outgoing": "source"}
#: The least and the greatest key in each file of the tables.
MANIFEST = "table string, file string, low long, high long, rows long"

PAIRS = "pair_id long, source_in long, target_in long"
PATHS = (
    "source long, source_is_redirect boolean, target long, target_is_redirect boolean, "
    "links map<string,array<long>>, language_code string, date_code string, length int, count long"
)

#: The greatest page id: 32 bits without sign.
MAX_PAGE_ID = 4294967295
