"""Operators, one module per survey area: columns (J), setops (U), joins (JO),
profile (P), clean (C), encode (E), features (F), scale (K), sampling (R),
select (X), models (M), evaluate (V), ensemble (B), neighbors (k-NN)."""
