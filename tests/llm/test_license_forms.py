"""Short forms of licenses, and words that only look like one."""

import pytest

from shelfwright.llm.licenses import RULES, detections, may_match, scan

CASES = [
    ("GPLv3", "gpl-3.0"), ("see GPL-2.0-or-later", "gpl-2.0"), ("MPL-2.0", "mpl-2.0"), ("apache-2.0", "apache-2.0"), ("LGPLv2.1+", "lgpl-2.1"), ("AGPL-3.0-only", "agpl-3.0"), ("BSD-3-Clause", "bsd-3-clause"),
    ("the Zope Public License", "zpl-2.1"), ("ZPL-2.1", "zpl-2.1"), ("CeCILL-B", "cecill-b"), ("Server Side Public License v1", "sspl-1.0"), ("SSPL-1.0", "sspl-1.0"), ("Elastic License 2.0", "elastic-2.0"),
    ("Business Source License 1.1", "busl-1.1"), ("Academic Free License v3.0", "afl-3.0"), ("OSL-3.0", "osl-3.0"), ("CC-BY-SA-4.0", "cc-by-sa-4.0"),
    ("die Software License mit der Zusatzklausel", ""), ("license MIT", "mit"), ("an example 2 0 of simple things", ""), ("replied 2 0", ""), ("", ""), (None, ""),
]


@pytest.mark.parametrize(("text", "labels"), CASES)
def test_labels(text, labels):
    assert scan(text)[5] == labels


def test_the_prefilter_misses_no_rule():
    for text, labels in CASES:
        line = " ".join("".join(c if c.isalnum() else " " for c in (text or "").lower()).split())
        assert may_match(line) or not detections(line)
        assert bool(detections(line)) == bool(labels)
    assert len(RULES) > 370
