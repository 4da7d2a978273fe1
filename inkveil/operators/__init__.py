"""Detection, masking, verification, findings, geometry and evaluation."""
