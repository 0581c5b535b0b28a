"""Groundledger: land-record analytics and corpus preparation on PySpark."""
