"""Dependencies between tables and the stages that run over them."""
