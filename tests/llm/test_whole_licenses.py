"""Entire licence texts are known."""

from pathlib import Path

import pytest

from corpusflow.llm.licenses import scan_licenses

FOLDER = Path("/usr/share/common-licenses")
FILES = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not FOLDER.is_dir(), reason="no licence texts")
def test_entire_texts(spark):
    texts = [(FOLDER / f).read_text() for f in FILES]
    rows = [*enumerate(texts), (90, texts[0] + " and more"), (91, texts[3][:-200])]
    got = {r["doc_id"]: r["license_id"] for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(enumerate(FILES.values())), 90: None, 91: None}
