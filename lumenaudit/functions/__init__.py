"""lumenaudit.functions"""
