import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from creditspark.session import local_session

    s = local_session("*", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def spectrum(spark):
    """1,000 loans, PD linspace(.01, .60), amount 10,000, rate .18, CoF .06, LGD .45, term 12."""
    import numpy as np

    from creditspark.sources.portfolio import ingest_rows

    pds = [float(x) for x in np.linspace(0.01, 0.60, 1000)]
    rows = [{"application_id": i, "pd": p, "loan_amount": 10000.0, "interest_rate": 0.18,
             "cost_of_funds": 0.06, "loan_term_months": 12} for i, p in enumerate(pds)]
    return ingest_rows(spark, rows)
