"""Reservation-risk analytics as Spark DataFrame operators."""
