"""Part of filingloom; see README.md."""
