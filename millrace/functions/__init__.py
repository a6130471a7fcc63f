"""Part of millrace; see the README for what lives where."""
