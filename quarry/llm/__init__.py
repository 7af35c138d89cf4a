"""Training-data operators. Nothing outside this folder imports it, apart from the guarded entry point."""
