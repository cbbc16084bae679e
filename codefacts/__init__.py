"""Code analytics on Spark: source trees as fact tables, diagnostics as DataFrame queries."""
