"""Column functions: text rules (``text``), per-row scores (``scores``), draws (``draws``)."""
