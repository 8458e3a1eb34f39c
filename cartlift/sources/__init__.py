"""Sources and sinks: raw loyalty tables, the driver-table fixture views,
customer sampling and result writers."""

from cartlift.sources.fixtures import fixture_tables
from cartlift.sources.raw import (load_tables, prepare_clients, prepare_purchases,
                                  prepare_train, reference_time, sample_customers,
                                  sampled_purchases, write_tables)

__all__ = ["fixture_tables", "load_tables", "prepare_clients", "prepare_purchases",
           "prepare_train", "reference_time", "sample_customers", "sampled_purchases",
           "write_tables"]
