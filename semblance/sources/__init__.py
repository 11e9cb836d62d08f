"""Tables in and out: CSV, stored datasets, stored models."""
