"""lumenaudit.operators"""
