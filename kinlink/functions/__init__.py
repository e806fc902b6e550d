"""Part of kinlink."""
