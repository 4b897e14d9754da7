import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sigloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def contigs(spark):
    """Build ``genome_id, ord, name, seq`` from ``{genome: [sequences]}``."""
    def build(genomes):
        rows = [(g, i, f"c{i}", s) for g, seqs in genomes.items() for i, s in enumerate(seqs)]
        return spark.createDataFrame(rows, "genome_id long, ord long, name string, seq string")
    return build
