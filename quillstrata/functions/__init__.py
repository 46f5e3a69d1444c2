"""Part of quillstrata."""
